"""Token-id output compressed by Re-Pair grammars.

Documents are encoded with a public tokenizer, ordered by doc_id and cut into shards of bounded size. Every shard has a
grammar of its own: its most frequent id pairs are replaced by nonterminals, round by round, until no pair occurs often
enough to pay for its rule. Each round goes down to an EIGHTH of the frequency that the one before it took. A
shard stores its rules, the expansion length of each nonterminal, the compressed sequence and a directory of its
documents, so that any document, or any range of ids in one, is decoded without the rest. Pairs never hold the end id,
so no nonterminal spans two documents.

Defined cases: null and empty texts are the end id alone; repeated doc_ids stand one after the other, ordered by a hash
of their text; a null doc_id comes first; an empty table gives no shards; other columns are ignored; a text of any
length is one document of one shard.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from celerix.llm.common import bounded, lean, left, pieces, stored, text_bytes

END = 1
SHARD_TOKENS = 1 << 20
MIN_COUNT = 6  # a rule takes 12 bytes, an occurrence of a pair saves 2
EIGHTH = 8
KNOWN_PIECES = 500_000  # about 30 MB
KNOWN_BYTES = 32 << 20  # of words that are no plain pieces
PIECE_BYTES = 24
ENCODE_BYTES = 1 << 19  # of text encoded at once, or one longer text

WHITE, LETTER, SIGN, ODD = range(4)


def _kinds() -> np.ndarray:
    """Of each byte: ASCII white space, letters, signs that are neither letters, digits nor apostrophes; the rest is odd."""
    kinds = np.full(256, ODD, np.uint8)
    for kind, held in ((WHITE, b" \t\n\r\x0b\x0c"), (LETTER, bytes(range(97, 123)) + bytes(range(65, 91))), (SIGN, b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")):
        kinds[list(held)] = kind
    return kinds


_kind = _kinds()
_lower = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: what may follow C3 in a letter: U+00C0 to U+00FF but for the signs of multiplication and division; upper case among it, 0x20 below its lower case
_second = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])
_upper = _second & (np.arange(256) < 0x9F)
_masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """The tokenizer's ids of whole texts.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its space-separated words
    in order. A word of letters and signs after them has two pieces, whose ids come from the library's model once while
    they are kept; pieces are lower-cased, cut and found again in whole batches, by their bytes. Any other word, and one
    with a piece of more than PIECE_BYTES, goes through the whole tokenizer once while it is kept. What is kept is bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.id = self.tokenizer.model.tokenize, attrgetter("id")
        self.letters = byte_letters() | {ord("\n"): "\n"}
        self.reset()

    def reset(self) -> None:
        self.words: dict[bytes, int] = {}  # entries of words that are no pieces
        self.words_bytes = 0
        self.n = 1  # entries; the first stands for nothing
        self.keys = [np.zeros(1 << 16, np.uint64) for _ in range(PIECE_BYTES // 8)]  # bytes of each entry that is a piece
        self.bounds = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.slots = np.zeros(1 << 17, np.int32)  # entries of pieces by hash, at least half of them free

    def _add(self, lists: list[bytes]) -> None:
        """Entries with these ids, each a row of 4-byte numbers."""
        sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
        at, need = self.bounds[self.n - 1], int(sizes.sum())
        while len(self.bounds) < self.n + len(lists):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.keys = [np.concatenate([k, np.zeros_like(k)]) for k in self.keys]
        while len(self.ids) < at + need:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.bounds[self.n : self.n + len(lists)] = at + np.cumsum(sizes)
        self.ids[at : at + need] = np.frombuffer(b"".join(lists), np.uint32)
        self.n += len(lists)

    def _slot(self, keys: list[np.ndarray]) -> np.ndarray:
        x = keys[0] * np.uint64(0x9E3779B97F4A7C15)
        for k, odd in zip(keys[1:], (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=True):
            x += k * np.uint64(odd)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x >> np.uint64(65 - len(self.slots).bit_length())).view(np.int64)

    def _place(self, entries: np.ndarray) -> None:
        at, last = self._slot([k[entries] for k in self.keys]), len(self.slots) - 1
        while len(entries):
            free = self.slots[at] == 0
            self.slots[at[free]] = entries[free]
            lost = self.slots[at] != entries
            entries, at = entries[lost], at[lost] + 1 & last

    def _pieces(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Entries of pieces, given by their places in raw, PIECE_BYTES before its end at least; new ones are learned."""
        view = np.ndarray((len(raw) - 7,), "<u8", raw.data, 0, (1,))
        keys = [view[start + 8 * k] & _masks[np.clip(size - 8 * k, 0, 8)] for k in range(len(self.keys))]
        at, last = self._slot(keys), len(self.slots) - 1
        found = self.slots[at]
        open_ = np.arange(len(at))
        while True:  # on to the next slot where another piece is met
            open_ = open_[found[open_] != 0]
            entry, other = found[open_], np.zeros(len(open_), bool)
            for own, k in zip(self.keys, keys, strict=True):
                other |= own[entry] != k[open_]
            open_ = open_[other]
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & last
            found[open_] = self.slots[at[open_]]
        new = np.flatnonzero(found == 0)
        if len(new):
            new = new[np.lexsort([k[new] for k in keys])]
            first = np.zeros(len(new), bool)
            first[0] = True
            for k in keys:
                first[1:] |= k[new[1:]] != k[new[:-1]]
            found[new] = self.n - 1 + np.cumsum(first)
            new = new[first]
            text = raw.tobytes()
            shown = b"\n".join([text[a : a + n] for a, n in zip(start[new].tolist(), size[new].tolist(), strict=True)])
            entries = np.arange(self.n, self.n + len(new), dtype=np.int32)
            self._add([array("I", map(self.id, self.tokenize(x))).tobytes() for x in shown.decode("latin-1").translate(self.letters).split("\n")])
            for own, k in zip(self.keys, keys, strict=True):
                own[entries] = k[new]
            if 2 * self.n > len(self.slots):
                while 2 * self.n > len(self.slots):
                    self.slots = np.zeros(2 * len(self.slots), np.int32)
                entries = np.flatnonzero(self.keys[0][: self.n]).astype(np.int32)
            self._place(entries)
        return found

    def _odd(self, words: list[bytes]) -> list[int]:
        """Entries of words that are no pieces; new ones go through the whole tokenizer."""
        fresh = [w for w in dict.fromkeys(words) if w not in self.words]
        self.words.update(zip(fresh, range(self.n, self.n + len(fresh)), strict=True))
        self.words_bytes += sum(map(len, fresh))
        self._add([array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in fresh], add_special_tokens=False)])
        return [self.words[w] for w in words]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, END after each, and the number of each text's ids."""
        if self.n > KNOWN_PIECES or self.words_bytes > KNOWN_BYTES:
            self.reset()
        joined = b"\n".join([*texts, bytes(PIECE_BYTES)])
        raw = np.frombuffer(joined, np.uint8)
        lower, kind = _lower[raw], _kind[raw]
        kind[len(raw) - PIECE_BYTES :] = WHITE
        lead = np.flatnonzero(raw == 0xC3)
        lead = lead[_second[raw[lead + 1]]]
        kind[lead] = kind[lead + 1] = LETTER
        lower[lead[_upper[raw[lead + 1]]] + 1] += 0x20
        edges = np.flatnonzero(np.diff(kind == WHITE, prepend=True))
        start, stop = edges[::2], edges[1::2]
        # a word is plain if none of its bytes is odd and no letter stands after a sign
        sign, letter = kind == SIGN, kind == LETTER
        odd = np.zeros(len(start), bool)
        for bad in (np.flatnonzero(kind == ODD), np.flatnonzero(letter[1:] & sign[:-1]) + 1):
            odd[np.searchsorted(start, bad, "right") - 1] = True
        signs = np.flatnonzero(np.diff(sign, prepend=False) & sign)
        base = stop.copy()
        base[np.searchsorted(start, signs, "right") - 1] = signs
        odd |= (base - start > PIECE_BYTES) | (stop - base > PIECE_BYTES)
        which = np.zeros((len(start), 2), np.int32)
        for column, (a, b) in enumerate(((start, base), (base, stop))):
            some = np.flatnonzero(~odd & (b > a))
            which[some, column] = self._pieces(lower, a[some], (b - a)[some])
        some = np.flatnonzero(odd)
        if len(some):
            which[some, 0] = self._odd([joined[a:b] for a, b in zip(start[some].tolist(), stop[some].tolist(), strict=True)])
        per = np.searchsorted(start, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1))  # words up to each text's end
        which = which.ravel()
        held = np.flatnonzero(which)
        lo = self.bounds[which[held] - 1]
        size = self.bounds[which[held]] - lo
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.arange(total) + np.repeat(lo - (ends - size), size)]
        upto = np.concatenate([[0], ends])[np.searchsorted(held, 2 * per)]
        n = np.diff(upto, prepend=0)
        out = np.full(total + len(texts), END, np.uint32)
        out[np.arange(total) + np.repeat(np.arange(len(texts)), n)] = flat
        return out, n + 1


def encoder(path: str) -> WordEncoder:
    encoders = left("tokens")
    if path not in encoders:
        encoders[path] = WordEncoder(path)
    return encoders[path]


def _slot(pair: np.ndarray) -> np.ndarray:
    slot = pair.astype(np.uint64)
    slot *= np.uint64(0x9E3779B97F4A7C15)
    slot >>= np.uint64(44)
    return slot.view(np.int64)


def repair(ids: np.ndarray, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, rules n x 2, first nonterminal): Re-Pair to the end, in rounds.

    The first round takes the pairs at least an EIGHTH as frequent as the first, each next one goes an EIGHTH further down;
    where two replacements meet, the more frequent pair wins. It ends when no pair occurs min_count times.
    """
    sequence = ids.astype(np.uint32)
    first = int(sequence.max(initial=0)) + 1
    rules: list[np.ndarray] = []
    symbols = first
    table = np.zeros(1 << 20, np.int32)
    least = 1 << 62
    while len(sequence) > 1:
        # a pair as one number; the end id with itself, which never is replaced, stands for all pairs that hold it
        wide, shift = (np.uint32, 16) if symbols <= 1 << 16 else (np.uint64, 32)
        pair = sequence[:-1].astype(wide) << wide(shift) | sequence[1:]
        none = wide(END << shift | END)
        ends = np.flatnonzero(sequence == END)
        pair[ends[ends < len(pair)]] = pair[ends[ends > 0] - 1] = none
        # of a run of one pair only every second place can be replaced, and counts
        again = np.flatnonzero(pair[1:] == pair[:-1]) + 1
        if len(again):
            new = np.concatenate([[True], np.diff(again) > 1])
            at = np.arange(len(again))
            pair[again[(at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0]] = none
        # pairs by hash: where fewer than min_count fall on a slot, none of them pays; the others are counted one by one
        slot = _slot(pair)
        some = np.bincount(slot, minlength=len(table)) >= min_count
        place = np.flatnonzero(some[slot] & (pair != none))
        if not len(place):
            break
        pair, slot = pair[place], slot[place]
        ordered = np.sort(pair)
        cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        count = np.diff(np.append(cut, len(ordered)))
        keys = ordered[cut]
        least = max(min_count, min(least, int(count.max())) // EIGHTH)
        good = count >= least
        keys, count = keys[good], count[good]
        if not len(keys):
            if least == min_count:
                break
            continue
        rank = np.empty(len(keys), np.int64)
        rank[np.lexsort((_slot(keys ^ wide(0x9E37)), -count))] = np.arange(len(keys), 0, -1)  # the highest for the most frequent, by hash among equals
        # each pair's key by hash; of keys that share a slot the most frequent keeps it, the others wait for the next round
        order = np.argsort(rank, kind="stable")
        table[_slot(keys[order])] = order
        rule = np.stack([keys >> wide(shift), keys & wide((1 << shift) - 1)], axis=1).astype(np.int64)
        at = np.minimum(table[slot], len(keys) - 1)
        found = keys[at] == pair
        place, at = place[found], at[found]
        won: list[tuple[np.ndarray, np.ndarray]] = []
        while len(place):  # the higher of neighbours wins, and what it overlaps goes
            beside = np.diff(place) == 1
            value = rank[at]
            wins = np.ones(len(place), bool)
            wins[1:] &= ~beside | (value[1:] > value[:-1])
            wins[:-1] &= ~beside | (value[:-1] >= value[1:])
            won.append((place[wins], at[wins]))
            gone = wins.copy()
            gone[1:] |= beside & wins[:-1]
            gone[:-1] |= beside & wins[1:]
            place, at = place[~gone], at[~gone]
        take, at = (np.concatenate(x) for x in zip(*won, strict=True))
        # where neighbours win over a pair its places may be too few for a rule; the most frequent pair's never are none
        enough = np.bincount(at, minlength=len(keys)) >= min_count
        enough[int(rank.argmax())] = True
        take, at = take[enough[at]], at[enough[at]]
        sequence[take] = symbols + (np.cumsum(enough) - 1)[at]
        sequence = np.delete(sequence, take + 1)
        rules.append(rule[enough])
        symbols += int(enough.sum())
    return sequence.astype(np.int64), np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), first


class Expansions:
    """What each nonterminal stands for: flat ids, where they start, how many they are. Rules refer to earlier ones only."""

    def __init__(self, rules: np.ndarray, first: int):
        self.first, n = first, len(rules)
        depth = np.zeros(n, np.int64)
        inner, below = rules >= first, np.maximum(rules - first, 0)
        while n:
            new = np.where(inner, depth[below] + 1, 0).max(1)
            if np.array_equal(new, depth):
                break
            depth = new
        self.lengths = np.ones(n, np.int64)
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=-1)) + 1)]
        for level in levels:
            self.lengths[level] = np.where(inner[level], self.lengths[below[level]], 1).sum(1)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.zeros(int(self.lengths.sum()), np.int64)
        for level in levels:
            left, right = rules[level].T
            at = self.starts[level]
            for part, to in ((left, at), (right, at + np.where(left >= first, self.lengths[np.maximum(left - first, 0)], 1))):
                ids, size = self._of(part)
                ends = np.cumsum(size)
                self.flat[np.arange(len(ids)) + np.repeat(to - (ends - size), size)] = ids

    def _of(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that a sequence stands for, and how many each of its symbols gives."""
        inner = sequence >= self.first
        if not inner.any():
            return sequence, np.ones(len(sequence), np.int64)
        below = np.where(inner, sequence - self.first, 0)
        size = np.where(inner, self.lengths[below], 1)
        ends = np.cumsum(size)
        out = self.flat[np.minimum(np.arange(int(ends[-1])) + np.repeat(np.where(inner, self.starts[below], 0) - (ends - size), size), len(self.flat) - 1)]
        out[(ends - size)[~inner]] = sequence[~inner]
        return out, size

    def of(self, sequence: np.ndarray) -> np.ndarray:
        return self._of(sequence.astype(np.int64))[0]


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal stands for."""
    return Expansions(rules, first).lengths


def expand(sequence: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    return Expansions(rules, first).of(sequence)


def _packed(values: np.ndarray) -> tuple[bytes, int]:
    """Low 16 bits as little-endian words, then each higher bit as a plane."""
    planes = max(0, int(values.max(initial=0)).bit_length() - 16)
    return (values & 0xFFFF).astype("<u2").tobytes() + b"".join(np.packbits((values >> (16 + k) & 1).astype(np.uint8)).tobytes() for k in range(planes)), planes


class Shard:
    """RPS1 | header length | JSON header | doc_ids i8 | null flags u1 | document starts in the sequence u4 | in ids u4 | rules u4 | lengths u4 | sequence."""

    MAGIC = b"RPS1"

    @classmethod
    def dump(cls, doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
        sequence, rules, first = repair(ids)
        lengths = expansion_lengths(rules, first)
        starts = np.concatenate([[0], np.flatnonzero(np.isin(np.cumsum(np.where(sequence >= first, lengths[np.maximum(sequence - first, 0)] if len(rules) else 1, 1)), np.cumsum(sizes))) + 1])
        body, planes = _packed(sequence)
        head = json.dumps({"docs": len(doc_ids), "rules": len(rules), "first": first, "symbols": len(sequence), "planes": planes}).encode()
        parts = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), starts.astype("<u4"), np.concatenate([[0], np.cumsum(sizes)]).astype("<u4"), rules.astype("<u4"), lengths.astype("<u4")]
        return cls.MAGIC + len(head).to_bytes(4, "little") + head + b"".join(p.tobytes() for p in parts) + body

    def __init__(self, blob: bytes):
        if blob[:4] != self.MAGIC:
            raise ValueError("not a shard")
        n = int.from_bytes(blob[4:8], "little")
        head, self._at, self._blob = json.loads(blob[8 : 8 + n]), 8 + n, blob
        docs, n_rules, self.first, symbols = head["docs"], head["rules"], head["first"], head["symbols"]
        ids, nulls = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [None if x else int(d) for d, x in zip(ids, nulls, strict=True)]
        self.starts, self.offsets = self._take("<u4", docs + 1).astype(np.int64), self._take("<u4", docs + 1).astype(np.int64)
        self.rules = self._take("<u4", 2 * n_rules).astype(np.int64).reshape(-1, 2)
        self.lengths = self._take("<u4", n_rules).astype(np.int64)
        self.sequence = self._take("<u2", symbols).astype(np.int64)
        for k in range(head["planes"]):
            self.sequence |= np.unpackbits(self._take("u1", -(-symbols // 8)), count=symbols).astype(np.int64) << (16 + k)
        self._expansions: Expansions | None = None

    def expand(self, sequence: np.ndarray) -> np.ndarray:
        """Ids of a part of the sequence; what the nonterminals stand for is made at first use."""
        self._expansions = self._expansions or Expansions(self.rules, self.first)
        return self._expansions.of(sequence)

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._blob, kind, n, self._at)
        self._at += out.nbytes
        return out

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, end id included."""
        return self.expand(self.sequence[self.starts[k] : self.starts[k + 1]])

    def ids(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the k-th document: only the symbols that cover them are expanded."""
        part = self.sequence[self.starts[k] : self.starts[k + 1]]
        size = np.where(part >= self.first, self.lengths[np.maximum(part - self.first, 0)] if len(self.lengths) else 1, 1)
        ends = np.cumsum(size)
        a, b = int(np.searchsorted(ends, start, "right")), int(np.searchsorted(ends, stop, "left")) + 1
        skip = int(ends[a - 1]) if a else 0
        return self.expand(part[a:b])[start - skip : stop - skip]


def write_shards(docs: DataFrame, tokenizer_path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Stored shards (part, number, n_tokens, shard) of all documents in ascending doc_id order by (part, number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = encoder(tokenizer_path).encode, TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        names: list[int | None] = []

        def cut() -> pa.RecordBatch:
            nonlocal number
            blob = Shard.dump(names, np.concatenate(sizes), np.concatenate(ids))
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), pa.array([sum(map(len, ids))], pa.int64()), pa.array([blob], pa.binary())], ["part", "number", "n_tokens", "shard"])
            number += 1
            for x in (ids, sizes, names):
                x.clear()
            return out

        for batch in batches:
            for some in pieces(batch, "text", ENCODE_BYTES):
                flat, n = encode(text_bytes(some.column("text")))
                ids.append(flat)
                sizes.append(n)
                names += some.column("doc_id").to_pylist()
                if sum(map(len, ids)) >= shard_tokens:
                    yield cut()
        if names:
            yield cut()

    text = F.col("text").cast("string")
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # ranges of doc_id and hash: rows of one id, however many, are shared out
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return stored(ordered.mapInArrow(lean(run, "tokens"), "part long, number long, n_tokens long, shard binary"), "tokens")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the stored shards."""
    sizes = shards.select("part", "number", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each range of ids
    parts = parts.select(F.col("part").alias("p"), (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    inside = sizes.withColumn("inside", F.sum("n_tokens").over(W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens"))
    base = inside.join(parts, inside["part"] == parts["p"]).select(F.col("part").alias("bp"), F.col("number").alias("bn"), (F.col("before") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "number", "shard")), strict=True):
                shard = Shard(blob)
                flat = shard.expand(shard.sequence).astype("<u4")
                n = len(shard.doc_ids)
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(shard.offsets[:-1].tolist(), shard.offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([number] * n, pa.int64()), pa.array(shard.doc_ids, pa.int64()), pa.array(shard.offsets[:-1]), pa.array(np.diff(shard.offsets)), pa.array(crc, pa.int64())], ["part", "number", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = shards.select("part", "number", "shard").mapInArrow(lean(run, "tokens"), "part long, number long, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(base, (rows["part"] == base["bp"]) & (rows["number"] == base["bn"])).select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
