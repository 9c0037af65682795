"""SentencePiece encoding and decoding by batched numpy Viterbi.

A text is cut where no piece can stand across (no piece holds the two characters side by
side), and equal segments are encoded once. Segments of equal length advance together, one
character a step: rolling hashes of all substrings that end there probe the sorted hashes
of the pieces, the candidates are rated, and the best one's length is the backpointer.

In a unigram model a candidate's rating is the sum of scores along its path. In a BPE model
merges decide: of the pieces that end a prefix exactly one is the last piece of the
prefix's own encoding, that which is compatible with the last piece before it (encoding the
two together gives the two again). So the rating is that compatibility, worked out once for
each pair of pieces by undoing their merges, and the path is the model's own encoding.

Segments where merges tie (runs of spaces) are merged plainly, by score and then place.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import in_parts, lean, ship

#: The public model that is used without another path; a model file of more bytes is refused for broadcast.
MODEL, MODEL_BYTES = "/opt/tokenizers/piece_bpe_32k.model", 64 << 20
SPACE = "▁"
#: Bytes of texts that are encoded at once.
AT_ONCE = 1 << 20
#: Encoded segments that a worker holds; segments longer than this are cut at safe places.
HELD, LONG = 150_000, 48
#: Upper bits of a hash by which pieces are found, and by which a pair of pieces has its place in memory.
BITS, PAIR_BITS = 20, 19
PRIME = np.uint64(0x9E3779B97F4A7C15)
# Piece and model types of the file format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


@dataclass
class Model:
    """A model's pieces and what is derived from them. data: the bytes of a .model file."""

    data: bytes
    kind: int = UNIGRAM
    prefix: bool = True
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)

    def __post_init__(self):
        for number, value in _fields(self.data):
            if number == 1:
                parts = dict(_fields(value))
                self.pieces.append(parts[1].decode())
                self.scores.append(struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0)
                self.types.append(parts.get(3, NORMAL))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1) or not spec.get(5, 1):
                    raise ValueError("only models that leave the text as it is, but for spaces, are supported")
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are supported")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t in (NORMAL, USER)}
        self.bytes = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, self.types)) if t == BYTE}
        self.unknown = next((i for i, t in enumerate(self.types) if t == UNKNOWN), 0)
        self.side = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.longest = max(map(len, self.ids), default=1)
        self.order = {i: (-self.scores[i]) for i in self.ids.values()}
        whole = sorted(self.ids.items(), key=lambda x: x[1])
        keys = np.array([_hash(p) for p, _ in whole], dtype=np.uint64)
        place = np.argsort(keys)
        self.keys, self.key_ids = keys[place], np.array([i for _, i in whole], dtype=np.int64)[place]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces have one hash")
        # most substrings are no pieces: a table by the hashes' upper bits says so, and where the sorted keys with these bits begin
        upper = (self.keys >> np.uint64(64 - BITS)).astype(np.int64)
        self.begin = np.searchsorted(upper, np.arange((1 << BITS) + 1)).astype(np.int32)
        self.maybe = np.diff(self.begin) > 0
        self.most = int(np.diff(self.begin).max(initial=0))
        self.score = np.array(self.scores, dtype=np.float64)
        if self.kind == BPE:
            self._merges()
        raw = [
            bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, t in zip(self.pieces, self.types)
        ]
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_len = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len
        self.known = Places()
        self.pool, self.pool_n = np.empty(1 << 16, np.int32), 0
        self.seg_at, self.seg_len, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), np.zeros(1 << 14, np.int32)
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)

    # --- merges of a BPE model

    def _merges(self) -> None:
        """rank: place of a piece in the order of merges; left, right: the last merge that makes it; sound: its own text gives it back."""
        n = len(self.pieces)
        self.rank = np.full(n, -1, np.int64)
        for r, i in enumerate(sorted(self.ids.values(), key=lambda i: (len(self.pieces[i]) > 1, self.order[i], i))):
            self.rank[i] = r
        self.by_rank = np.zeros(len(self.ids), np.int64)
        self.by_rank[self.rank[self.rank >= 0]] = np.flatnonzero(self.rank >= 0)
        self.left, self.right = np.arange(n), np.arange(n)
        self.sound = np.zeros(n, bool)
        tied = {s for s, c in _counts(self.order.values()).items() if c > 1}
        ties = {p for p, i in self.ids.items() if self.order[i] in tied and len(p) > 1}
        self.tied = [p for p in ties if not any(q != p and q in p for q in ties)]  # a segment with a longer one has these too
        for p, i in self.ids.items():
            steps: list[tuple[int, int, int]] = []
            out = self.merged(p, steps)
            self.sound[i] = out == [i]
            if self.sound[i] and steps:
                self.left[i], self.right[i] = steps[-1][:2]
        # the pair that a concatenation in the vocabulary would merge, by the key of the pair
        pairs = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        key = np.array([a * n + b for a, b, _ in pairs], dtype=np.int64)
        place = np.argsort(key)
        self.join_keys, self.join_rank = key[place], self.rank[np.array([i for *_, i in pairs], dtype=np.int64)][place]

    def merged(self, segment: str, steps: list | None = None) -> list[int]:
        """The encoding of a segment by merges: best score first, then the place; bytes for unknown characters."""
        parts = list(segment)
        while len(parts) > 1:
            best = min(((self.order[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = best[1]
            if steps is not None:
                steps.append((self.ids.get(parts[k], -1), self.ids.get(parts[k + 1], -1), self.ids[parts[k] + parts[k + 1]]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [i for p in parts for i in ([self.ids[p]] if p in self.ids else self.spelled(p))]

    def spelled(self, char: str) -> list[int]:
        """A character without a piece: its bytes, or the unknown piece in a model without bytes."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether encoding the pieces a and b together gives a and b. A pair has one place in memory, where the last pair that fell there stands."""
        keys = a.astype(np.int64) * len(self.pieces) + b
        place = ((keys.view(np.uint64) * PRIME) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        found = self.pairs[place]
        ok = (found & 1).astype(bool)
        miss = np.flatnonzero(found >> 1 != keys)
        if len(miss):
            new, back = np.unique(keys[miss], return_inverse=True)
            holds = self._walk(new // len(self.pieces), new % len(self.pieces))
            ok[miss] = holds[back]
            self.pairs[place[miss]] = 2 * keys[miss] + holds[back]
        return ok

    def _walk(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the later of the two sides' last merges again and again; a merge across the border that
        would have come before the one undone last shows that the border does not hold."""
        n, a, b = len(self.pieces), a.copy(), b.copy()
        ok, open_ = np.ones(len(a), bool), np.arange(len(a))
        # a merge across counts while its (rank, side) comes before the limit; at equal rank the left one is made first
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(open_):
            x, y, top = a[open_], b[open_], limit[open_]
            at = np.minimum(np.searchsorted(self.join_keys, x * n + y), max(0, len(self.join_keys) - 1))
            joins = (self.join_keys[at] == x * n + y) & (2 * self.join_rank[at] + 1 < top) if len(self.join_keys) else np.zeros(len(x), bool)
            ok[open_[joins]] = False
            open_ = open_[~joins]
            x, y = a[open_], b[open_]
            single_x, single_y = self.left[x] == x, self.left[y] == y
            rx, ry = np.where(single_x, -1, self.rank[x]), np.where(single_y, -1, self.rank[y])
            done = single_x & single_y
            undo_x = ~done & (rx >= ry)
            undo_y = ~done & ~undo_x
            # equal pieces on both sides: the left one was merged first, so the right one is undone first
            same = undo_x & (rx == ry)
            undo_x, undo_y = undo_x & ~same, undo_y | same
            limit[open_[undo_x]] = 2 * rx[undo_x] + 1
            a[open_[undo_x]] = self.right[x[undo_x]]
            limit[open_[undo_y]] = 2 * ry[undo_y] + 2
            b[open_[undo_y]] = self.left[y[undo_y]]
            open_ = open_[~done]
        return ok

    # --- segments

    @cached_property
    def cuts_words(self) -> bool:
        """Whether no piece holds a space after another character."""
        return not any(x[1] == SPACE and x[0] != SPACE for x in self.side)

    @cached_property
    def plain(self) -> bool:
        """Whether words by themselves are segments, and line breaks stand alone."""
        return self.cuts_words and self.prefix and not any("\n" in p for p in self.ids)

    def names(self, text: str) -> list[str]:
        """The segments of a text by name: a word stands for itself after a space, and a line break and what follows for themselves; U+2581 before any other segment."""
        if self.plain and not ("  " in text or SPACE in text or text[:1] == " " or text[-1:] == " "):
            return (text.replace("\n", " \n") if "\n" in text else text).split(" ")
        marked = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        return [_name(s) for s in (re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked) if self.cuts_words else [marked])]

    def safe(self, segment: str) -> list[str]:
        """A segment's parts: its line break and its last character (a full stop, mostly) by themselves where no piece holds them and their neighbour, a long one cut at all such places."""
        if len(segment) > LONG:
            cuts = [i for i in range(1, len(segment)) if segment[i - 1 : i + 1] not in self.side]
        else:
            n = len(segment)
            cuts = sorted({i for i in (1 if segment[:1] == "\n" else 0, n - 1) if 0 < i < n and segment[i - 1 : i + 1] not in self.side})
        return [segment[i:j] for i, j in zip([0, *cuts], [*cuts, len(segment)])] if cuts else [segment]

    def learn(self) -> None:
        """Encodes the segments that were met anew: those of equal length advance together."""
        known, side = self.known, self.side
        new, known.new = known.new, []
        first = len(known) - len(new)  # names have places in the order in which they came
        cut: dict[int, tuple[int, ...]] = {}
        whole: list[tuple[int, str]] = []
        for place, name in enumerate(new, first):
            if 1 < len(name) < LONG and name[0] not in "\n" + SPACE:  # a word: see safe()
                if name[-2:] in side:
                    whole.append((place, SPACE + name))
                else:
                    cut[place] = known[name[:-1]], known[SPACE + name[-1]]
            elif len(parts := self.safe(s := _segment(name))) == 1:
                whole.append((place, s))
            else:
                cut[place] = tuple(known[_name(p)] for p in parts)
        whole += [(place, _segment(name)) for place, name in enumerate(known.new, first + len(new))]
        known.new = []
        if self.kind == BPE and self.tied:
            ties = re.compile("|".join(map(re.escape, self.tied)))
            tied = [x for x in whole if ties.search(x[1])] if ties.search("\0".join(s for _, s in whole)) else []
            for place, s in tied:
                ids = self.merged(s)
                self._keep(np.array([place]), np.array(ids, dtype=np.int64), np.array([len(ids)]))
            whole = [x for x in whole if not ties.search(x[1])] if tied else whole
        whole.sort(key=lambda x: len(x[1]))
        lengths = np.fromiter((len(s) for _, s in whole), np.int64, len(whole))
        for length in np.unique(lengths).tolist():
            start, end = np.searchsorted(lengths, [length, length + 1]).tolist()
            step = max(1, (1 << 17) // length)
            for at in range(start, end, step):
                part = whole[at : min(end, at + step)]
                self._keep(np.array([i for i, _ in part]), *self.viterbi([s for _, s in part], length))
        if cut:
            lists = [x if not any(j in cut for j in x) else _leaves(cut, i) for i, x in cut.items()]
            parts, n = np.array([i for x in lists for i in x]), np.array([len(x) for x in lists])
            sizes = self.seg_len[parts]
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])]
            self._keep(np.array(list(cut)), self.pool[_spread(self.seg_at[parts], sizes)], np.diff(ends))

    def forget(self) -> None:
        """Keeps the segments that were met most often, half as many as may be held."""
        names = list(self.known)
        often = np.flatnonzero(self.used[: len(names)] > 1)
        if len(often) > HELD // 2:
            often = np.sort(often[np.argsort(-self.used[often], kind="stable")[: HELD // 2]])
        sizes, used = self.seg_len[often], self.used[often]
        flat = self.pool[_spread(self.seg_at[often], sizes)]
        self.known = Places((names[i], k) for k, i in enumerate(often.tolist()))
        self.pool_n, self.used[:] = 0, 0
        if len(often):
            self._keep(np.arange(len(often)), flat, sizes)
            self.used[: len(often)] = used // 2

    def _keep(self, places: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> None:
        most, end = len(self.known), self.pool_n + len(flat)
        if most > len(self.seg_at):
            self.seg_at, self.seg_len, self.used = (np.concatenate([x, np.zeros(most + most // 4 - len(x), x.dtype)]) for x in (self.seg_at, self.seg_len, self.used))
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.pool_n], np.empty(end + end // 4 - self.pool_n, np.int32)])
        self.pool[self.pool_n : end] = flat
        self.seg_at[places] = self.pool_n + np.cumsum(sizes) - sizes
        self.seg_len[places] = sizes
        self.pool_n = end

    def candidates(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, size, id) of all substrings of chars (rows, length) that are pieces, by end and then size; a character without a piece has id -2."""
        n, length = chars.shape
        level = np.zeros((n, length), np.uint64)
        found: list[tuple] = []
        for size in range(1, min(self.longest, length) + 1):
            level = level[:, : length - size + 1] * PRIME + chars[:, size - 1 :]
            mixed = level * PRIME + np.uint64(size)
            upper = (mixed >> np.uint64(64 - BITS)).view(np.int64)
            row, start = np.nonzero(self.maybe[upper])
            sought, at = mixed[row, start], self.begin[upper[row, start]].astype(np.int64)
            ids = np.full(len(row), -1, np.int64)
            for k in range(self.most):
                here = np.minimum(at + k, len(self.keys) - 1)
                ids = np.where(self.keys[here] == sought, self.key_ids[here], ids)
            good = np.flatnonzero(self.sound[ids] & (ids >= 0) if self.kind == BPE else ids >= 0)
            row, start, ids = row[good], start[good], ids[good]
            if size == 1:
                every = np.full((n, length), -2, np.int64)
                every[row, start] = ids
                row, start, ids = np.repeat(np.arange(n), length), np.tile(np.arange(length), n), every.ravel()
            found.append((row.astype(np.int32), start.astype(np.int32), np.full(len(row), size, np.int32), ids.astype(np.int32)))
        row, start, size, ids = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(start + size if length > 60 else (start + size).astype(np.int8), kind="stable")
        return row[order], start[order], size[order], ids[order]

    def viterbi(self, group: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of segments of one length."""
        n = len(group)
        if not length:
            return np.empty(0, np.int64), np.zeros(n, np.int64)
        chars = np.frombuffer("".join(group).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(n, length).astype(np.uint64) + np.uint64(1)
        row, start, size, ids = self.candidates(chars)
        ends = np.searchsorted(start + size, np.arange(length + 2))
        last, back = np.full((length + 1, n), -1, np.int32), np.zeros((length + 1, n), np.int32)
        last[0] = -3
        best, low = np.zeros((length + 1, n)), self.score.min() - 10.0
        for end in range(1, length + 1):
            part = slice(ends[end], ends[end + 1])
            who, begin, piece, z = row[part], start[part], ids[part], size[part]
            prev = last[begin, who]
            if self.kind == BPE:
                ok = prev != -1
                pair = np.flatnonzero((prev >= 0) & (piece >= 0))
                if len(pair):
                    ok[pair] = self.compatible(prev[pair], piece[pair])
                # of each segment the longest candidate that holds; they come in order of length
                held = np.flatnonzero(ok)
                last[end, who[held]], back[end, who[held]] = piece[held], z[held]
            else:
                rating = np.full((n, min(self.longest, end) + 1), -np.inf)
                rating[who, z] = best[begin, who] + np.where(piece >= 0, self.score[np.maximum(piece, 0)], low)
                named = np.full(rating.shape, -1, np.int32)
                named[who, z] = piece
                pick, each = rating.argmax(axis=1), np.arange(n)
                best[end], last[end], back[end] = rating[each, pick], named[each, pick], pick
        # all paths are walked back together; path[k] is the k-th piece from the end
        path: list[np.ndarray] = []
        end, each = np.full(n, length), np.arange(n)
        while (end > 0).any():
            path.append(np.where(end > 0, last[end, each], -9))
            end = end - np.where(end > 0, np.maximum(back[end, each], 1), 0)
        ids = np.stack(path[::-1], axis=1)
        odd = np.flatnonzero(((ids == -1) | (ids == -2)).any(axis=1))
        if not len(odd):
            return ids[ids >= 0], (ids >= 0).sum(axis=1)
        lists = [x[x >= 0] for x in ids]
        for i in odd.tolist():
            lists[i] = np.array(self._spelled_out(group[i], ids[i].tolist()), dtype=np.int64)
        return np.concatenate(lists), np.array([len(x) for x in lists])

    def _spelled_out(self, segment: str, path: list[int]) -> list[int]:
        """A path with characters that have no piece; without a path (no piece ends somewhere) the merges decide."""
        if -1 in path:
            return self.merged(segment)
        out: list[int] = []
        at = 0
        for p in path:
            if p >= 0:
                out.append(p)
                at += len(self.pieces[p])
            elif p == -2:
                out += self.spelled(segment[at])
                at += 1
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the ids of all texts, text after text, and how many each has. A null text has none."""
        if len(self.known) > HELD:
            self.forget()
        place = self.known.__getitem__
        cut = [np.fromiter(map(place, names), np.int32, len(names)) if t else np.empty(0, np.int32) for t in texts for names in (self.names(t) if t else (),)]
        self.learn()
        order = np.concatenate(cut) if cut else np.empty(0, np.int32)
        sizes = self.seg_len[order]
        flat = self.pool[_spread(self.seg_at[order], sizes)]
        self.used[: len(self.known)] += np.bincount(order, minlength=len(self.known)).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        cuts = np.concatenate([[0], np.cumsum([len(x) for x in cut], dtype=np.int64)])
        return flat, ends[cuts[1:]] - ends[cuts[:-1]]

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[str]:
        """The texts of ids; bytes that make no character become U+FFFD; the space that encoding put in front goes."""
        ids = np.asarray(ids, dtype=np.int64)
        sizes = self.raw_len[ids]
        data = self.raw[_spread(self.raw_at[ids], sizes)].tobytes()
        ends = np.concatenate([[0], np.cumsum(sizes)])
        cuts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        out = []
        for a, b in zip(ends[cuts[:-1]].tolist(), ends[cuts[1:]].tolist()):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if self.prefix and text[:1] == " " else text)
        return out


def _hash(piece: str) -> int:
    level = 0
    for c in piece:
        level = (level * int(PRIME) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return (level * int(PRIME) + len(piece)) & 0xFFFFFFFFFFFFFFFF


def _counts(values) -> dict:
    out: dict = {}
    for v in values:
        out[v] = out.get(v, 0) + 1
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then the same from starts[1] and so on."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) < 1 << 31) else np.int64
    out = np.repeat((starts - ends + sizes).astype(kind), sizes)
    out += np.arange(total, dtype=kind)
    return out


class Places(dict):
    """Places of segments by name, in the order in which they were met; new has the names that are yet to be encoded."""

    def __init__(self, known=()):
        super().__init__(known)
        self.new: list[str] = []

    def __missing__(self, name: str) -> int:
        self[name] = place = len(self)
        self.new.append(name)
        return place


def _leaves(cut: dict[int, tuple[int, ...]], i: int) -> list[int]:
    """The parts of a segment, and of parts that are cut themselves theirs."""
    return [k for j in cut[i] for k in _leaves(cut, j)] if i in cut else [i]


def _segment(name: str) -> str:
    return name[1:] if name[:1] == SPACE else name if name[:1] == "\n" else SPACE + name


def _name(segment: str) -> str:
    if segment[:1] == SPACE and segment[1:2] not in (SPACE, "\n"):
        return segment[1:]
    return segment if segment[:1] == "\n" else SPACE + segment


_loaded: dict[int, Model] = {}


def model_of(data: bytes) -> Model:
    """The model of a file's bytes, held by the process."""
    key = hash(data)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(data)
    return _loaded[key]


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        data = f.read(MODEL_BYTES + 1)
    if len(data) > MODEL_BYTES:
        raise ValueError(f"{path} has more than {MODEL_BYTES} bytes")
    return data


def encoded(docs: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = MODEL) -> DataFrame:
    """(row, token_ids, n_tokens, round_trip): row has the columns keep (None: all).

    round_trip: whether decoding gives the text back; false for a text that holds U+2581,
    which the models use for the space. Null and empty texts have no ids. Very long texts
    and words are encoded whole. Rows repeat as given; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast(model_bytes(path))
    columns = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{text}`").alias("t"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data.value)
        for batch in batches:
            for part, texts in in_parts(batch.column(1), AT_ONCE):
                ids, lengths = model.encode(texts)
                back = model.decode(ids, lengths)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(ids))
                same = pa.array([a == (b or "") for a, b in zip(back, texts)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], lists, pa.array(lengths), same], ["row", "token_ids", "n_tokens", "round_trip"])

    like = rows.select("row", F.array(F.lit(0)).alias("token_ids"), F.lit(0).cast("long").alias("n_tokens"), F.lit(True).alias("round_trip"))
    return rows.mapInArrow(lean(work), like.schema)


def decoded(docs: DataFrame, ids: str = "token_ids", path: str = MODEL) -> DataFrame:
    """docs with the column text (replaced if there) decoded from ids; null ids give the empty text.

    An id outside the model's pieces fails the query. Very long lists are decoded whole, rows
    repeat as given, an empty table gives an empty one; other columns may have any names.
    """
    spark = docs.sparkSession
    ship(spark)
    data = spark.sparkContext.broadcast(model_bytes(path))
    keep = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{ids}`"), F.array().cast("array<int>")).alias("i"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data.value)
        for batch in batches:
            lists = [np.asarray(x.as_py(), dtype=np.int64) for x in batch.column(1)]
            texts = model.decode(np.concatenate(lists) if lists else np.empty(0, np.int64), np.array([len(x) for x in lists], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    return rows.mapInArrow(lean(work), rows.select("row", F.lit("").cast("string").alias("text")).schema).select("row.*", "text")
