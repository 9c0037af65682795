"""Quality rules with cross-document line frequency. DataFrame functions only.

Each line of a text is normalised and hashed; a line that stands in too large a share of
the distinct documents of its host (here: source) is boilerplate and is removed; a document
of which too little is left is rejected. Base rules on the text itself come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import LOWER, UPPER, WORD, fixed, packed, small_or_not, written

#: A line is removed when it stands in at least MIN_DOCS distinct documents of its host
#: and in more than MAX_SHARE percent of them.
MIN_DOCS, MAX_SHARE = 5, 10
#: A document is depleted when more than this percentage of its words stood in removed lines.
MAX_LOST = 70
#: Frequent lines are broadcast up to this many rows; texts that hold some, up to four times as many texts and lines.
BROADCAST_ROWS = 50_000
#: Base rules: fewest words; most words in repeated 3-word windows, in percent.
MIN_WORDS, MAX_REPEAT = 50, 50


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def normal_line(line: Column) -> Column:
    """A-Z lower-cased, white space to single spaces, trimmed."""
    line = F.translate(line, UPPER, LOWER)
    return F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def sorted_windows(words: str) -> Column:
    """(hash, place) of each 3-word window of an array column, in order of the hash."""
    w = F.col(words)
    return F.sort_array(
        F.transform(
            F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
        )
    )


def repeated_places(windows: str) -> Column:
    """The places, in order, of the windows whose hash stands twice or more."""
    s = F.col(windows)
    twice = F.filter(s, lambda x, j: F.get(s, j - 1)["h"].eqNullSafe(x["h"]) | F.get(s, j + 1)["h"].eqNullSafe(x["h"]))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def covered(places: str) -> Column:
    """The words that windows at these places cover, three each, every word once."""
    p = F.col(places)
    steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x).cast("long")


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, th, tn): th and tn tell texts apart."""
    t = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    full = F.filter(lines_of(t), lambda x: x.rlike(WORD))
    cut = packed(docs).select("row", words_of(t).alias("words"), full.alias("full"))
    cut = cut.withColumn("windows", sorted_windows("words"))
    cut = cut.withColumn("places", repeated_places("windows"))
    made = cut.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("full") - F.size(F.array_distinct("full"))).cast("long").alias("n_dup_lines"),
        covered("places").alias("n_repeat_words"),
        F.xxhash64(t).alias("th"),
        F.length(t).alias("tn"),
    )
    return fixed(made, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def lost_lines(docs: DataFrame, text: str, host: str, min_docs: int, max_share: int) -> DataFrame:
    """(l_host, l_th, l_tn, gone, lost_words): for each distinct text of a host that has some, its lines above the limits."""
    t = F.coalesce(F.col(text), F.lit(""))
    named = docs.select(F.col(host).cast("string").alias("host"), F.xxhash64(t).alias("th"), F.length(t).alias("tn"), t.alias("t"))
    each = named.select("host", "th", "tn", F.explode(lines_of(F.col("t"))).alias("line")).filter(F.col("line").rlike(WORD))
    each = each.select("host", "th", "tn", normal_line(F.col("line")).alias("line"))
    n_words = F.length("line") - F.length(F.translate("line", " ", "")) + 1
    lines = each.select("host", "th", "tn", F.xxhash64("line").alias("lh")).distinct()
    copies = named.groupBy("host", "th", "tn").agg(F.count("*").alias("copies"))
    sizes = copies.groupBy(F.col("host").alias("s_host")).agg(F.count("*").alias("docs"))
    common = lines.groupBy(F.col("host").alias("f_host"), F.col("lh").alias("f_lh")).agg(F.count("*").alias("df"))
    common = common.filter(F.col("df") >= min_docs)
    above = common.join(sizes, common.f_host.eqNullSafe(sizes.s_host)).filter(F.col("df") * 100 > F.col("docs") * max_share)
    above = small_or_not(written(above.select("f_host", "f_lh"), "quality-lines"), BROADCAST_ROWS)
    raw = each.select("host", "th", "tn", F.xxhash64("line").alias("lh"), n_words.alias("w"))
    hit = raw.join(above, raw.host.eqNullSafe(F.col("f_host")) & (raw.lh == F.col("f_lh")))
    lost = hit.groupBy(F.col("host").alias("l_host"), F.col("th").alias("l_th"), F.col("tn").alias("l_tn")).agg(
        F.sum("w").alias("all_w"), F.collect_set("lh").alias("gone")
    )
    # w is summed over the copies of a text
    both = lost.join(copies, F.col("host").eqNullSafe(F.col("l_host")) & (F.col("th") == F.col("l_th")) & (F.col("tn") == F.col("l_tn")))
    both = both.select("l_host", "l_th", "l_tn", "gone", (F.col("all_w") / F.col("copies")).cast("long").alias("lost_words"))
    return small_or_not(written(both, "quality-lost"), 4 * BROADCAST_ROWS, F.size("gone") + 1)


def judged(
    docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = MIN_DOCS, max_share: int = MAX_SHARE, max_lost: int = MAX_LOST, keep: list[str] | None = None
) -> DataFrame:
    """(row, the base metrics, gone, lost_words, base_failed, kept) of every document; row has the columns keep (None: all).

    gone: hashes of its removed lines, null if none. A null or empty text has no words and
    fails; null hosts are one host. A line counts a distinct text of the host once: copies
    of a text are near-dedup's matter, and must not make each other boilerplate. Very long
    texts are judged whole. An empty table gives an empty one; rows repeat as given.
    """
    lost = lost_lines(docs, text, host, min_docs, max_share)
    base = metrics(docs, text)
    if keep is not None:
        base = base.withColumn("row", F.struct(*[F.col("row").getField(c).alias(c) for c in dict.fromkeys([*keep, host])]))
    joined = base.join(
        lost, F.col("row").getField(host).cast("string").eqNullSafe(F.col("l_host")) & (F.col("th") == F.col("l_th")) & (F.col("tn") == F.col("l_tn")), "left"
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT)
    lost_words = F.coalesce("lost_words", F.lit(0).cast("long"))
    return joined.select(
        "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "gone",
        lost_words.alias("lost_words"), failed.alias("base_failed"), (~failed & (lost_words * 100 <= F.col("n_words") * max_lost)).alias("kept"),
    )


def cleaned(docs: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The kept documents with docs' own columns, lines above the limits taken out of their texts; n_chars, if there, follows.

    Null, empty and short texts are rejected; null hosts are one host; rows that repeat are each
    judged alike and all stay. Very long texts are read whole. An empty table gives an empty one;
    columns of docs may have any names.
    """
    verdict = judged(docs, text, host, **limits).filter("kept")
    t = F.col("row").getField(text)
    left = F.filter(lines_of(t), lambda x: ~F.array_contains("gone", F.xxhash64(normal_line(x))))
    new = F.when(F.col("gone").isNull(), t).otherwise(F.array_join(left, "\n"))
    out = fixed(verdict.withColumn("new", new), "new")
    swap = {text: F.col("new"), "n_chars": F.length("new").cast("long")}
    return out.select(*[(swap[c] if c in swap else F.col("row").getField(c)).alias(c) for c in docs.columns])


def oracle(table: str = "documents") -> str:
    """DuckDB SQL of the op6 columns."""
    line = r"""trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"""
    return rf"""
with d as (select doc_id, source, coalesce("text", '') t, row_number() over () rid from {table}),
w as (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls from d),
e as (select rid, unnest(range(1, len(ws) - 1)) i, ws from w where len(ws) >= 3),
g as (select rid, i, count(*) over (partition by rid, ws[i], ws[i + 1], ws[i + 2]) c from e),
r as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from g where c > 1) group by 1),
ln as (select source, t, line from (select distinct source, t, unnest(string_split(t, chr(10))) line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
nl as (select distinct source, t, {line} l from ln),
df as (select source, l, count(*) df from nl group by 1, 2),
sz as (select source, count(distinct t) n from d group by 1),
fq as (select df.source, l from df join sz on df.source is not distinct from sz.source where df >= {MIN_DOCS} and df * 100 > n * {MAX_SHARE}),
al as (select rid, source, unnest(string_split(t, chr(10))) line from d),
lw as (select rid, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) n from al join fq on al.source is not distinct from fq.source and {line} = fq.l group by 1),
m as (select doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
  coalesce(r.n, 0)::bigint n_repeat_words, coalesce(lw.n, 0)::bigint lost_words
  from d join w using (rid) left join r using (rid) left join lw using (rid)),
v as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost_words * 100 <= n_words * {MAX_LOST} kept, lost_words from v"""
