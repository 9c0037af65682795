"""sparkloom.streaming"""
