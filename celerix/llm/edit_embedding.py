"""Document fingerprints by randomised edit embedding.

A walk over a text stands on one character at each step; whether the step moves on to the next character is a random
bit drawn from the step and the character, the same for all texts. Texts that differ by few edits soon walk in step
again, so their edit distance bounds the Hamming distance of their embeddings (the characters stood on, one a step).
The walk goes by table lookups: from a step and a character to the step at which that character is left.

A fingerprint samples one bit of BITS embedded characters at each of two scales: a scale 2^q spreads its steps over the
first 2 * 2^q, and a text of n characters uses q = floor(log2 n) and q + 1, so the larger covers the whole walk and texts
of like length share a scale. It is the text `q:bits of q:mask and bits of q + 1` in hexadecimal; the mask tells steps
within the text from those beyond its end.

Defined cases: null and empty texts have the fingerprint `-`, are 1 like each other and 0 like anything else; equal
texts have equal fingerprints; texts of any length are walked whole; rows of one doc_id are ordered by a hash of their text; a null doc_id comes first; a
table of one document is its own next; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celerix.llm.common import bounded, mix64, pieces, stored

BITS = 128
PERIOD = 4096  # steps after which the walk's random bits repeat
CLASSES = 256  # characters share random bits by class
BAND = 16  # sampled bits of a band
BANDS = 32  # bands of a scale
BLOCK = 512  # classes of a bucket, about, that meet as many others in one task
GRAM = 4  # characters of the runs that are counted before an edit distance is computed
EMPTY = "-"

_step = np.arange(2 * PERIOD, dtype=np.uint64)
_moves = (mix64(np.arange(CLASSES, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (_step % np.uint64(PERIOD))[None]) & np.uint64(1)).astype(bool)
_moves[:, PERIOD - 1 :: PERIOD] = True  # no stay is endless
#: steps that the walk stays on a character of a class met at a step
_after = np.minimum.accumulate(np.where(_moves, np.arange(2 * PERIOD), 2 * PERIOD)[:, ::-1], axis=1)[:, ::-1]
STAY = (_after[:, :PERIOD] - np.arange(PERIOD) + 1).astype(np.int16).ravel()


def sampled_steps(scale: int) -> np.ndarray:
    """BITS ascending steps below 2 * 2^scale."""
    span = max(2 << scale, 2)
    return np.sort((mix64(np.arange(BITS, dtype=np.uint64) + np.uint64(scale * 1000 + 7)) >> np.uint64(11)).astype(np.float64) / 2.0**53 * span).astype(np.int64)


_steps = {q: sampled_steps(q) for q in range(0, 40)}


def walks(codes: np.ndarray, bounds: np.ndarray, begin: np.ndarray | None = None, first: np.ndarray | None = None) -> np.ndarray:
    """For every character of the texts (code points, text k in bounds[k]:bounds[k+1]) the step at which the walk reaches it.

    begin and first let a text's walk start within it: at its begin[k]-th character, reached at step first[k].
    """
    n = np.diff(bounds)
    classes = (codes * np.uint32(2654435761) >> np.uint32(24)).astype(np.int64) * PERIOD
    reached = np.zeros(len(codes), np.int64)
    skip = np.zeros(len(n), np.int64) if begin is None else begin
    left = n - skip
    order = np.argsort(-left, kind="stable")
    order = order[left[order] > 0]
    at = bounds[:-1][order] + skip[order]
    step = np.zeros(len(order), np.int64) if first is None else first[order].astype(np.int64)
    live = left[order]
    counts = np.bincount(live, minlength=1)
    active = len(order)
    for i in range(int(live[0]) if len(live) else 0):
        active -= counts[i] if i else 0
        here = at[:active] + i
        s = step[:active]
        reached[here] = s
        s += STAY[classes[here] + (s & (PERIOD - 1))]
    return reached


def sample(codes: np.ndarray, reached: np.ndarray) -> str:
    """Fingerprint of one text from its code points and the steps at which they are reached."""
    n = len(codes)
    if not n:
        return EMPTY
    q = n.bit_length() - 1
    parts = [f"{q}"]
    for scale in (q, q + 1):
        steps = _steps[scale]
        on = np.searchsorted(reached, steps, "right") - 1
        inside = steps < reached[-1] + 2  # the last character is stood on for one step or two at least
        bits = (mix64(codes[on].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.arange(BITS, dtype=np.uint64)) >> np.uint64(40) & np.uint64(1)).astype(bool) & inside
        if scale == q:
            parts.append(np.packbits(bits).tobytes().hex())
        else:
            parts.append(np.packbits(inside).tobytes().hex() + np.packbits(bits).tobytes().hex())
    return ":".join(parts)


def _read(fingerprint: str) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    q, one, two = fingerprint.split(":")
    bits = lambda x: np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8)).astype(bool)
    half = len(two) // 2
    return {int(q): (np.ones(BITS, bool), bits(one)), int(q) + 1: (bits(two[:half]), bits(two[half:]))}


def likeness(a: str, b: str) -> float:
    """0 to 1: how far the sampled bits agree beyond chance at the largest scale that both have; steps that only one text reaches count as differing."""
    if a == b:
        return 1.0
    if EMPTY in (a, b):
        return 0.0
    one, two = _read(a), _read(b)
    scale = max(one.keys() & two.keys(), default=None)
    if scale is None:
        return 0.0
    (ma, x), (mb, y) = one[scale], two[scale]
    either = ma | mb
    agree = int(((x == y) & ma & mb).sum()) / max(1, int(either.sum()))
    return max(0.0, 2 * agree - 1)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints_of(texts: list[str]) -> list[str]:
    codes = [_codes(t) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    flat = np.concatenate([np.zeros(0, np.uint32), *codes])
    reached = walks(flat, bounds)
    return [sample(c, reached[a:b]) for c, a, b in zip(codes, bounds[:-1], bounds[1:], strict=True)]


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _with_next(docs: DataFrame) -> DataFrame:
    """Rows doc_id, text in bands of doc_id, ascending within a band; every band ends with a copy (`guest`) of the next band's first row."""
    spark = docs.sparkSession
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = rows.select("doc_id").filter("doc_id is not null")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(ids.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.001 / parts if parts > 64 else 0.002))) if parts > 1 else []
    edges = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # the number of cuts below the id
    band = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.aggregate(edges, F.lit(0), lambda n, c: n + (c < F.col("doc_id")).cast("int")))
    banded = rows.withColumn("band", band).withColumn("tie", F.xxhash64("text"))
    firsts = rows.select("doc_id").withColumn("band", band).groupBy("band").agg(F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).collect()  # one row a band
    used = sorted(r["band"] for r in firsts)
    before = {b: used[k - 1] for k, b in enumerate(used)}  # the first band's first row goes to the last band
    least = {r["band"]: None if r["nulls"] else r["least"] for r in firsts}
    if not used:
        return banded.select("band", F.lit(False).alias("guest"), "doc_id", "tie", "text")
    back = F.create_map(*[F.lit(x) for b in used for x in (b, before[b])])
    low = F.create_map(*[F.lit(x) for b in used for x in (b, least[b] if least[b] is not None else -(1 << 63))])
    is_first = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))) == low[F.col("band")]
    copies = F.when(is_first, F.array(F.struct(F.lit(False).alias("guest"), F.col("band")), F.struct(F.lit(True).alias("guest"), back[F.col("band")].alias("band")))).otherwise(F.array(F.struct(F.lit(False).alias("guest"), F.col("band"))))
    return banded.withColumn("copy", F.explode(copies)).select(F.col("copy.band").alias("band"), F.col("copy.guest").alias("guest"), "doc_id", "tie", "text")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, next text)."""
        codes = [_codes(t) for _, t, _ in rows]
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        reached = walks(np.concatenate([np.zeros(0, np.uint32), *codes]), bounds)
        kept = np.array([len(c) - len(c) // 4 for c in codes], np.int64)
        tails = [_codes(n[: len(c) // 4]) for c, (_, _, n) in zip(codes, rows, strict=True)]
        # the edited text's walk is the text's own up to the edit
        other = [np.concatenate([c[:k], t]) for c, k, t in zip(codes, kept, tails, strict=True)]
        last = np.maximum(kept - 1, 0)
        edge = np.concatenate([[0], np.cumsum([len(c) for c in other])]).astype(np.int64)
        start = np.array([reached[bounds[k] + last[k]] if len(codes[k]) else 0 for k in range(len(rows))], np.int64)
        again = walks(np.concatenate([np.zeros(0, np.uint32), *other]), edge, np.minimum(last, np.diff(edge)), start)
        out = []
        for k, (doc, text, following) in enumerate(rows):
            again[edge[k] : edge[k] + last[k]] = reached[bounds[k] : bounds[k] + last[k]]
            changed = edited(text, following)
            a, b = sample(codes[k], reached[bounds[k] : bounds[k + 1]]), sample(other[k], again[edge[k] : edge[k + 1]])
            out.append((doc, len(codes[k]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), a, b, likeness(a, b)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(6)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row whose next is not yet known
        pending: list[tuple] = []
        chars = 0
        shown: tuple | None = None  # row without near_next, as its next's fingerprint is not yet known

        def done(final_guest: str | None) -> Iterator[pa.RecordBatch]:
            """Fingerprints of the pending rows; near_next needs the one that follows, so the last waits unless the guest's is given."""
            nonlocal pending, chars, shown
            batch = flush(pending)
            pending, chars = [], 0
            prints = batch.column("fingerprint").to_pylist()
            follow = prints[1:] + [final_guest]
            if shown is not None:
                yield _shown(shown, likeness(shown.column("fingerprint")[0].as_py(), prints[0]))
                shown = None
            n = batch.num_rows if final_guest is not None else batch.num_rows - 1
            if n:
                near = [likeness(a, b) for a, b in zip(prints[:n], follow[:n], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(0, n).columns, pa.array(near, pa.float64())], [*batch.schema.names, "near_next"])
            if n < batch.num_rows:
                shown = batch.slice(n, 1)

        band = None
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                for b, guest, doc, text in zip(*(part.column(c).to_pylist() for c in ("band", "guest", "doc_id", "text")), strict=True):
                    text = text or ""
                    if held is not None and b == band:
                        pending.append((*held, text))
                        chars += len(held[1])
                    if guest:
                        yield from done(fingerprints_of([text])[0])
                        held, band = None, None
                        continue
                    held, band = (doc, text), b
                    if chars > 6 << 20:
                        yield from done(None)
        if pending or shown is not None:
            raise RuntimeError("a band has no guest")

    rows = _with_next(docs)
    # in a band: its rows by id and hash of the text, then its guest; of several first rows the least is the guest
    ordered = rows.repartition("band").sortWithinPartitions("band", "guest", "doc_id", "tie")
    return ordered.mapInArrow(_one_guest(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _one_guest(run):
    """run, without the guests that follow a band's first one."""

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keep = []
            for b, guest in zip(batch.column("band").to_pylist(), batch.column("guest").to_pylist(), strict=True):
                keep.append(not guest or last != b)
                if guest:
                    last = b
            yield batch.filter(pa.array(keep))

    return lambda batches: run(filtered(batches))


def _shown(row: pa.RecordBatch, near: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*row.columns, pa.array([near], pa.float64())], [*row.schema.names, "near_next"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", 4 << 20):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprints_of(texts), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


_drawn = np.argsort(mix64(np.arange(BANDS * BITS, dtype=np.uint64) + np.uint64(5_000_003)).reshape(BANDS, BITS), axis=1)[:, :BAND]  # BAND of the sampled bits for each band


def bands_of(fingerprint: str) -> list[int]:
    """Band keys: for each scale BANDS times BAND of its sampled bits; masked bits are zero, and a band of masked bits alone has no key."""
    if fingerprint == EMPTY:
        return []
    out: list[int] = []
    for scale, (mask, bits) in _read(fingerprint).items():
        live = mask[_drawn].any(1)
        value = (bits[_drawn].astype(np.int64) << np.arange(BAND)).sum(1)
        out += ((np.int64(scale) << 40) + (np.arange(BANDS, dtype=np.int64) << 24) + value)[live].tolist()
    return out


def edit_distance(a: str, b: str, most: int) -> int | None:
    """Levenshtein distance if it is at most `most`, by a band of diagonals."""
    if abs(len(a) - len(b)) > most:
        return None
    x, y = _codes(a), _codes(b)
    if len(x) > len(y):
        x, y = y, x
    reach = {0: _slide(x, y, 0, 0)}  # furthest place in x on each diagonal (place in y less place in x)
    goal = len(y) - len(x)
    for e in range(most + 1):
        if reach.get(goal, -1) >= len(x):
            return e
        new = {}
        for d in range(-(e + 1), e + 2):
            best = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            if best >= 0 and best <= len(x) and 0 <= best + d <= len(y):
                new[d] = _slide(x, y, best, d)
            elif best > len(x) and 0 <= len(x) + d <= len(y):
                new[d] = len(x)
        reach = new
    return None


def _slide(x: np.ndarray, y: np.ndarray, i: int, d: int) -> int:
    n = min(len(x) - i, len(y) - i - d)
    step = 64
    while n > 0:
        k = min(step, n)
        differ = np.flatnonzero(x[i : i + k] != y[i + d : i + d + k])
        if len(differ):
            return i + int(differ[0])
        i, n, step = i + k, n - k, step * 2
    return i


def few_grams_shared(x: np.ndarray, y: np.ndarray, most: int) -> bool:
    """Whether the texts share fewer runs of GRAM characters than `most` edits could leave: an edit touches GRAM runs at most."""
    need = max(len(x), len(y)) - GRAM + 1 - GRAM * most
    if need <= 0:
        return False
    counts = []
    for c in (x, y):
        n = len(c) - GRAM + 1
        if n <= 0:
            return True
        run = np.zeros(n, np.uint64)
        for k in range(GRAM):
            run = mix64(run + c[k : n + k].astype(np.uint64) + np.uint64(k + 1))
        counts.append(np.unique(run, return_counts=True))
    (a, na), (b, nb) = counts
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    return int(np.minimum(na[i], nb[j]).sum()) < need


def near_pairs(docs: DataFrame, share: float = 0.05) -> DataFrame:
    """a, b, distance: all pairs of texts with an equal band whose edit distance is at most `share` of the longer one's length.

    Equal texts are one class, named by its least doc_id; pairs are between classes, the lesser name first (a null before
    all). Every pair of a bucket whose lengths allow it is verified: a bucket is cut into blocks of about BLOCK classes by
    hash, and each two blocks meet in a task of their own.
    """
    body = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("length(text) > 0")
    classes = body.withColumn("hash", F.sha2("text", 256)).groupBy("hash").agg(F.min("doc_id").alias("name"), F.first("text").alias("text"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("class"), "name", "text"), "classes")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [bands_of(f) for f in batch.column("fingerprint").to_pylist()]
            row = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(row), batch.column("n_chars").take(row), pa.array([x for k in keys for x in k], pa.int64())], ["class", "n_chars", "band"])

    prints = fingerprints(classes.select(F.col("class").alias("doc_id"), "text"))
    posts = stored(prints.mapInArrow(post, "class long, n_chars long, band long"), "posts")
    sizes = posts.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("k")).filter("k > 1")
    posts = posts.join(sizes.drop("k"), "band").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    one = posts.select("band", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"), F.col("class").alias("x"), F.col("n_chars").alias("nx"))
    two = posts.select("band", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), F.col("class").alias("y"), F.col("n_chars").alias("ny"))
    fits = F.abs(F.col("nx") - F.col("ny")) <= F.floor(F.lit(float(share)) * F.greatest("nx", "ny"))
    met = one.join(two, ["band", "i", "j"]).filter(((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))) & fits)
    pairs = stored(met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "pairs")
    text = lambda side: classes.select(F.col("class").alias(side), F.struct("name", "class").alias("n" + side), F.col("text").alias("t" + side))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[int | None] = []
            for x, y in zip(batch.column("tx").to_pylist(), batch.column("ty").to_pylist(), strict=True):
                most = int(share * max(len(x), len(y)))
                out.append(None if few_grams_shared(_codes(x), _codes(y), most) else edit_distance(x, y, most))
            yield pa.RecordBatch.from_arrays([batch.column("nx"), batch.column("ny"), pa.array(out, pa.int32())], ["nx", "ny", "distance"])

    near = pairs.join(text("x"), "x").join(text("y"), "y").select("nx", "ny", "tx", "ty")
    kind = "struct<name: bigint, class: bigint>"
    found = near.mapInArrow(verify, f"nx {kind}, ny {kind}, distance int").filter("distance is not null")
    return found.select(F.least("nx", "ny")["name"].alias("a"), F.greatest("nx", "ny")["name"].alias("b"), "distance")
