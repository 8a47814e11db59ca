"""Line dedup through a log-template tree of fixed depth (operator 5).

Texts are cut into records at line ends and after sentence ends. A record's tokens lead it down
the tree: first by their number, then by its ``depth`` leading tokens, where a token that holds
a digit is a variable field. At the leaf, a token is constant if ``min_docs`` documents of
the leaf share it at that place; the others become fields too, provided that ``similarity`` of the
tokens stay. Records of one template are one line with changing fields. A template needs
constant words, three at least and half of its tokens; records without them, such as rows of
numbers or prices, are one line only if their values are equal too.

A template found in ``min_docs`` documents or more is recurring. Its records are dropped from
all documents but the one with the smallest id, which keeps them. Three further rules:

* Records of more than ``long_tokens`` tokens are cut into pieces where a hash of two
  neighbouring tokens is the least around, so the inner pieces of a passage are the same in
  whatever line it stands. Such a record goes if all its pieces recur.
* A run of records or pieces that all recur in ``min_docs`` documents, or that all have the same
  first document among two or more, goes if it has ``run_tokens`` tokens or more. So long
  passages go that two documents share, also from the middle of a line; up to some ten words may
  stay at the ends of such a passage. On the evidence of two documents alone a document never
  loses ``copy_share`` of its tokens or more: it is then a copy, which is not this operator's business.
* A record of fewer than ``min_tokens`` tokens goes only alone between two others that go, and only
  if it follows the same record in ``min_docs`` documents. Runs pass over such records.

Each text is scanned twice by NumPy over whole Arrow batches: once to count hashes of leaves and
lines, once to give out what can recur. A bit field of bounded size tells what can; it may let too
much through, never too little, and exact counts follow. Counts are sums over all documents, with
partial sums in the map tasks: a hot line or leaf is never gathered.

Defined results: null texts stay null and empty ones empty; tokens are separated by ASCII white
space; a repeated row counts as one document with its twin, rows that share an id are one
document, and a null id is a document of its own that comes first; empty tables give no rows;
other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occupipe.llm.common import arrow, col, ddl, splitmix
from occupipe.llm.word_ids import slices
from occupipe.session import through_table

DEPTH = 3
MIN_DOCS = 3
MIN_TOKENS = 5
SIMILARITY = 0.8
LONG_TOKENS = 24
RUN_TOKENS = 30
COPY_SHARE = 0.8
NEAR = 4
SLICE = 1 << 20
#: Bits of the field of hashes that can recur: 16 for each, within these powers of two.
FIELD_BITS = (16, 28)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGNS = np.array(splitmix(5, 256), np.uint64)
_SIGNS[_SPACE] = 0
_BASE, _PLACE, _FIELD = (np.uint64(x | 1) for x in splitmix(55, 3))
WHOLE, PIECE, SHORT = 0, 1, 2


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64; only as many as a common slice asks for are kept."""

    KEPT = 1 << 21

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n <= len(self.up):
            return self.up[:n], self.down[:n]
        made = []
        for x in (self.base, self.inverse):
            each = np.full(1 << n.bit_length() if n < self.KEPT else n, x, np.uint64)
            each[0] = 1
            made.append(np.cumprod(each, dtype=np.uint64))
        if n < self.KEPT:
            self.up, self.down = made
        return made[0][:n], made[1][:n]


_BYTE_POWERS, _TOKEN_POWERS = _Powers(_BASE), _Powers(_PLACE)


def _hashes(values: np.ndarray, starts: np.ndarray, powers: _Powers) -> np.ndarray:
    """For each stretch of values between starts, the sum of its values by powers of their places in it."""
    if not len(starts):
        return values[:0]
    up, down = powers.of(len(values))
    return np.add.reduceat(values * up, starts) * down[starts]


class Units:
    """The records of a batch of texts and the pieces of the long ones, in order.

    All arrays have one entry a unit: ``row``, ``begun`` and ``stop`` (bytes in its text), ``at``
    (its place among those of the row that are not short; a short one has the place of the one before), ``record``
    (its record's place in the row), ``of`` (units of its record), ``size`` (tokens), ``kind``, ``mark`` (its
    identity), ``leaf`` (0 where it has none), and ``between`` (short, alone between two others).
    """

    def __init__(self, texts: pa.Array, depth: int, min_tokens: int, long_tokens: int) -> None:
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held is not None else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        space = _SPACE[data]
        first, last = ~space, ~space
        if len(data):
            first[1:] &= space[:-1]
            last[:-1] &= space[1:]
            inner = bounds[1:-1]
            inner = inner[(inner > 0) & (inner < len(data))]
            first[inner] = ~space[inner]
            last[inner - 1] = ~space[inner - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        begins_row = np.searchsorted(starts, bounds)
        row = np.repeat(np.arange(len(texts)), np.diff(begins_row))
        plain = _mix(_hashes(_SIGNS[data], starts, _BYTE_POWERS))
        has_digit = np.zeros(len(starts), bool)
        has_digit[np.searchsorted(starts, np.flatnonzero((data - np.uint8(48)) < 10), "right") - 1] = True
        masked = np.where(has_digit, _FIELD, plain)
        # A record begins with its row, after a line feed and after a sentence end.
        fresh = np.zeros(len(starts) + 1, bool)
        fresh[begins_row[:-1]] = True
        fresh[np.searchsorted(starts, np.flatnonzero(data == 10))] = True
        final = data[ends - 1]
        fresh[1:] |= (final == 46) | (final == 33) | (final == 63)
        fresh = fresh[:-1]
        record_starts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(record_starts, len(starts)))
        begins = fresh.copy()
        self._cut(begins, plain, record_starts, sizes, long_tokens)
        unit = np.flatnonzero(begins)
        record = np.searchsorted(record_starts, unit, "right") - 1
        self.row, self.begun = row[unit], starts[unit] - bounds[row[unit]]
        after = np.append(unit[1:], len(starts))
        self.first, self.size = unit, after - unit
        self.stop = ends[after - 1] - bounds[self.row]
        self.of = np.bincount(record, minlength=len(sizes))[record]
        first_unit = np.searchsorted(self.row, np.arange(len(texts)))
        if not len(unit):
            first_unit = first_unit[:0]
        in_row = lambda counted: counted - counted[first_unit[self.row]]
        self.record = in_row(record)
        length = _mix(self.size.astype(np.uint64))
        exact = _mix(_hashes(plain, unit, _TOKEN_POWERS) + length)
        general = _mix(_hashes(masked, unit, _TOKEN_POWERS) + length * _PLACE)
        numbers = np.bincount(np.searchsorted(unit, np.flatnonzero(has_digit), "right") - 1, minlength=len(unit))
        words = self.size - numbers
        wordy = words >= np.maximum(3, (self.size + 1) // 2)
        mark = np.where(wordy, general, exact)
        short = (self.of == 1) & (self.size < min_tokens)
        self.kind = np.where(self.of > 1, PIECE, np.where(short, SHORT, WHOLE)).astype(np.int8)
        full = np.cumsum(~short)
        self.at = in_row(full) + ~short[first_unit[self.row]] - 1
        inside = np.zeros(len(unit), bool)
        inside[1:-1] = (self.row[:-2] == self.row[2:]) & ~short[:-2] & ~short[2:]
        self.between = short & inside
        # A short record is told by the record before it, too.
        told = np.flatnonzero(self.between)
        mark[told] = _mix(exact[told] ^ (mark[told - 1] * _BASE))
        self.mark = (mark | np.uint64(1)).view(np.int64)
        leaf = length * _BASE
        for d in range(depth):
            leaf = _mix(leaf ^ (masked[np.minimum(unit + d, max(0, len(starts) - 1))] * np.uint64(2 * d + 1)))
        self.leaf = np.where((self.kind == WHOLE) & wordy, leaf & ~np.uint64(1), np.uint64(0)).view(np.int64)
        self.masked = masked.view(np.int64)

    @staticmethod
    def _cut(begins: np.ndarray, plain: np.ndarray, record_starts: np.ndarray, sizes: np.ndarray, long_tokens: int) -> None:
        """In long records, marks the tokens that begin a piece: their hash with the next token's is the least of those near, the first of equals."""
        long = np.flatnonzero(sizes > long_tokens)
        if not len(long):
            return
        n = sizes[long]
        ends = np.cumsum(n)
        tokens = np.arange(ends[-1]) + np.repeat(record_starts[long] - ends + n, n)
        value = _mix(plain[tokens] ^ (np.roll(plain[tokens], -1) * _PLACE))
        value[ends - 1] = ~np.uint64(0)  # the last token has no next one
        record = np.repeat(np.arange(len(long), dtype=np.int32), n)
        least = np.ones(len(tokens), bool)
        least[ends - 1] = False
        for step in range(1, NEAR + 1):
            other = record[step:] != record[:-step]
            lower = value[step:] < value[:-step]
            least[step:] &= other | lower
            least[:-step] &= other | ~lower
        begins[tokens[least]] = True


def _recurring_hashes(docs: DataFrame, cut: tuple, min_docs: int) -> DataFrame:
    """``hash`` and ``often`` (``min_docs`` rows or more) of the leaves and marks of rows enough; short records are left out."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                units = Units(batch.column("text"), *cut)
                full, leafy = units.kind != SHORT, units.leaf != 0
                hashes, rows = np.concatenate([units.mark[full], units.leaf[leafy]]), np.concatenate([units.row[full], units.row[leafy]])
                # Equal hashes are all marks or all leaves, so their rows are in order and stay so.
                order = np.argsort(hashes, kind="stable")
                hashes, rows = hashes[order], rows[order]
                new = _breaks(hashes)
                once = new.copy()
                once[1:] |= rows[1:] != rows[:-1]
                n = np.add.reduceat(once.astype(np.int64), np.flatnonzero(new)) if len(new) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hashes[new]), pa.array(n)], names=["hash", "n"])

    counts = arrow(docs.select("text"), each, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n"))
    # Marks are odd and leaves even.
    often = F.col("n") >= min_docs
    return through_table(counts.filter(F.when(F.col("hash") % 2 == 0, often).otherwise(F.col("n") > 1)).select("hash", often.alias("often")))


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in a field; its lowest bit tells marks from leaves only."""
    z, low = hashes.view(np.uint64), np.uint64((1 << bits) - 1)
    return (z >> np.uint64(1)) & low, (z >> np.uint64(30)) & low


def bit_field(hashes: DataFrame) -> np.ndarray:
    """16 bits for each hash, ``FIELD_BITS`` powers of two at least and at most, in words of 64 bits."""
    bits = min(FIELD_BITS[1], max(FIELD_BITS[0], (16 * hashes.count()).bit_length()))
    slots = F.array(*[F.shiftrightunsigned("hash", by).bitwiseAND(F.lit((1 << bits) - 1)) for by in (1, 30)])
    words = hashes.select(F.explode(slots).alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(slot & 63 as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    field = np.zeros(1 << (bits - 6), np.int64)
    field[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return field


def _held(field: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    words, found = field.view(np.uint64), np.ones(len(hashes), bool)
    for slot in _slots(hashes, (64 * len(field)).bit_length() - 1):
        found &= (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0
    return found


def _candidates(docs: DataFrame, some: np.ndarray, often: np.ndarray, cut: tuple) -> DataFrame:
    """The units that may recur, and short ones after those that may often; ``tokens`` are given where the leaf may.

    What is given out depends on the unit's mark and leaf only, so counts of it are whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast((some, often))
    schema = f"{ddl(docs, 'doc_id', 'twin')}, begun int, stop int, at int, record int, of int, size int, kind tinyint, mark bigint, leaf bigint, tokens array<bigint>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, often = sent.value
        for whole in batches:
            for batch in slices(whole, "text", SLICE):
                units = Units(batch.column("text"), *cut)
                in_leaf = (units.leaf != 0) & _held(often, units.leaf)
                full = units.kind != SHORT
                frequent = full & (in_leaf | _held(often, units.mark))
                kept = full & (in_leaf | _held(some, units.mark))
                kept[1:] |= units.between[1:] & frequent[:-1]
                kept = np.flatnonzero(kept)
                in_leaf, sizes = in_leaf[kept], np.where(in_leaf[kept], units.size[kept], 0)
                ends = np.append(0, np.cumsum(sizes))
                at = np.arange(ends[-1]) + np.repeat(units.first[kept] - ends[:-1], sizes)
                tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(units.masked[at]))
                row = pa.array(units.row[kept])
                numbers = [pa.array(getattr(units, c)[kept].astype(np.int32)) for c in ("begun", "stop", "at", "record", "of", "size")]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(row), batch.column("twin").take(row), *numbers, pa.array(units.kind[kept]), pa.array(units.mark[kept]),
                     pa.array(np.where(in_leaf, units.leaf[kept], 0), mask=~in_leaf), tokens],
                    names=["doc_id", "twin", "begun", "stop", "at", "record", "of", "size", "kind", "mark", "leaf", "tokens"],
                )

    return through_table(arrow(docs, each, schema))


def templates(candidates: DataFrame, depth: int, min_docs: int, similarity: float) -> DataFrame:
    """``leaf``, ``mark`` and ``template_id`` of every record that its leaf's constant tokens give a template."""
    held = candidates.filter("leaf is not null")
    # Counted by numbers alone, which Spark hashes; lists it would sort, so only those of the lines that matter are met.
    per_doc = held.select("leaf", "mark", "doc_id").distinct()
    distinct = through_table(per_doc.groupBy("leaf", "mark").agg(F.count(F.lit(1)).alias("docs")))
    many = distinct.groupBy("leaf").agg(F.count(F.lit(1)).alias("_lines"), F.sum("docs").alias("_docs"))
    many = many.filter((F.col("_lines") > 1) & (F.col("_docs") >= min_docs)).select("leaf")
    lines = through_table(distinct.join(many, "leaf", "left_semi"))
    listed = held.groupBy("leaf", "mark").agg(F.any_value("tokens").alias("tokens")).join(lines, ["leaf", "mark"])
    tokens = through_table(listed.select("leaf", "mark", "docs", F.posexplode("tokens").alias("at", "token")))
    # What leads to the leaf is constant there; only later places are counted.
    counted = tokens.filter(F.col("at") >= depth).groupBy("leaf", "at", "token").agg(F.sum("docs").alias("_n"))
    # Written first, so that the join has a shuffle of its own and a hot leaf can be split.
    shared = through_table(counted.filter(F.col("_n") >= min_docs).select("leaf", "at", "token", F.lit(True).alias("constant")))
    told = tokens.select("leaf", "mark", "at", "token").join(shared, ["leaf", "at", "token"], "left")
    fixed = F.coalesce("constant", F.col("at") < depth)
    field = F.lit(int(_FIELD.view(np.int64)))
    made = told.groupBy("leaf", "mark").agg(
        F.bit_xor(F.xxhash64("at", F.when(fixed, F.col("token")).otherwise(field))).alias("_shown"),
        F.avg(fixed.cast("int")).alias("_share"),
        F.sum((fixed & (F.col("token") != field)).cast("int")).alias("_words"),
        F.count(F.lit(1)).alias("_size"),
    )
    made = made.filter((F.col("_share") >= similarity) & (F.col("_words") >= F.greatest(F.lit(3), F.ceil(F.col("_size") / 2))))
    return made.select("leaf", "mark", F.xxhash64("leaf", "_shown").alias("template_id"))


def recurring(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, long_tokens: int = LONG_TOKENS,
) -> DataFrame:
    """Of a table with ``doc_id``, ``twin`` and ``text``: the units found in two documents or more.

    Each has its place (``begun``, ``stop``, ``at``, ``record``, ``of``, ``size``, ``kind``), the number ``docs`` of documents
    with its template and ``first_id``, the smallest of their ids.
    """
    cut = (depth, min_tokens, long_tokens)
    hashes = _recurring_hashes(docs, cut, min_docs)
    candidates = _candidates(docs, bit_field(hashes), bit_field(hashes.filter("often")), cut)
    # Written first, so that the join has a shuffle of its own and a hot line can be split.
    known = through_table(templates(candidates, depth, min_docs, similarity))
    marked = candidates.drop("tokens").join(known, ["leaf", "mark"], "left").withColumn("template_id", F.coalesce("template_id", "mark"))
    marked = through_table(marked.drop("leaf", "mark"))
    per_doc = marked.groupBy("template_id", "doc_id").agg(F.lit(1).alias("one"))
    # min() would pass over a null id, which sorts first.
    often = per_doc.groupBy("template_id").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("doc_id")).alias("first")).filter("docs > 1")
    often = through_table(often.select("template_id", "docs", F.col("first.doc_id").alias("first_id")))
    return marked.join(often, "template_id")


def _runs(breaks: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Which entries lie in a run, up to the next break, of ``least`` tokens or more."""
    if not len(sizes):
        return np.zeros(0, bool)
    starts = np.flatnonzero(breaks)
    return np.repeat(np.add.reduceat(sizes, starts) >= least, np.diff(np.append(starts, len(sizes))))


def _breaks(*keys: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def dropped_units(units: pa.StructArray, doc: np.ndarray, n_tokens: Callable[[int], int], min_docs: int, run_tokens: int, copy_share: float) -> np.ndarray:
    """Which units go; all recur and stand in an earlier document, which ``first_id`` names.

    ``doc`` numbers the documents that hold them; ``n_tokens`` gives the tokens of one.
    """
    at, record, of, size, kind, docs = (units.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("at", "record", "of", "size", "kind", "docs"))
    first = pc.fill_null(units.field("first_id").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
    gone, two = np.zeros(len(at), bool), np.zeros(len(at), bool)
    order = np.lexsort((at, doc))
    full = order[kind[order] != SHORT]
    often = full[docs[full] >= min_docs]
    # Records all of whose units recur.
    parts = _breaks(doc[often], record[often])
    gone[often] = _runs(parts, np.ones(len(often), np.int64), 1) & (np.bincount(np.cumsum(parts) - 1, minlength=1)[np.cumsum(parts) - 1] == of[often])
    place = lambda some: at[some] - np.arange(len(some))  # noqa: E731  constant while places follow each other
    gone[often] |= _runs(_breaks(doc[often], place(often)), size[often], run_tokens)
    two[full] = _runs(_breaks(doc[full], place(full), first[full]), size[full], run_tokens) & ~gone[full]
    taken = np.bincount(doc[gone | two], weights=size[gone | two], minlength=1)
    copies = [d for d in np.unique(doc[two]).tolist() if taken[d] >= copy_share * n_tokens(d)]
    gone |= two & ~np.isin(doc, copies)
    key = (doc << 32) + at
    left, right = np.isin(key, key[gone]), np.isin(key + 1, key[gone])
    return gone | (kind == SHORT) & (docs >= min_docs) & left & right


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the spans and without the white space that led on from them."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
        while at < len(text) and text[at : at + 1] in b" \t\n" and (not text[:a] or text[a - 1 : a] in b" \t\n"):
            at += 1
    out.append(text[at:])
    return b"".join(out).strip(b" \t\n\r\v\f")


def _twin(text: Column) -> Column:
    return F.xxhash64(text)


def without_recurring(
    docs: DataFrame, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, similarity: float = SIMILARITY, long_tokens: int = LONG_TOKENS,
    run_tokens: int = RUN_TOKENS, copy_share: float = COPY_SHARE, doc_id: str = "doc_id", text: str = "text", dropped: str | None = None,
) -> DataFrame:
    """The documents with the dropped records cut out of ``text``; all columns are kept.

    ``dropped`` names a further column for the number of records and pieces dropped, without the short ones between.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), _twin(col(text)).alias("twin"), col(text).alias("text"))
    held = recurring(rows, depth, min_docs, min_tokens, similarity, long_tokens)
    later = held.filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    # Twin rows hold the same units; each is listed once.
    unit = F.struct("begun", "stop", "at", "record", "of", "size", "kind", "docs", "first_id")
    found = later.groupBy(F.col("doc_id").alias("_unit_doc"), F.col("twin").alias("_unit_twin")).agg(F.collect_set(unit).alias("_units"))
    # The documents' columns get names of their own, so that none can clash.
    names = [f"_doc_{i}" for i in range(len(docs.columns))]
    here = docs.select(*[col(c).alias(n) for c, n in zip(docs.columns, names)])
    own_id, own_text = names[docs.columns.index(doc_id)], names[docs.columns.index(text)]
    same = F.col(own_id).eqNullSafe(F.col("_unit_doc")) & (_twin(F.col(own_text)) == F.col("_unit_twin"))
    joined = here.join(found.hint("shuffle_hash"), same, "left").select(*names, "_units")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_units")
            values = batch.column(own_text).cast(pa.binary())
            units = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            gone = np.flatnonzero(dropped_units(units, doc, lambda d: len(values[d].as_py().split()), min_docs, run_tokens, copy_share))
            counted = units.field("kind").to_numpy(zero_copy_only=False)[gone] != SHORT
            counts = np.bincount(doc[gone][counted], minlength=len(lists))
            begun, stop = (units.field(n).to_numpy(zero_copy_only=False)[gone].tolist() for n in ("begun", "stop"))
            ends = np.searchsorted(doc[gone], np.arange(len(lists) + 1)).tolist()
            changed = [i for i in range(len(lists)) if ends[i] < ends[i + 1]]
            texts = values.to_pylist() if changed else []
            for i in changed:
                texts[i] = cut(texts[i], list(zip(begun[ends[i] : ends[i + 1]], stop[ends[i] : ends[i + 1]])))
            text_column = pa.array(texts, pa.binary()).cast(pa.string()) if changed else batch.column(own_text)
            columns = [text_column if n == own_text else batch.column(n) for n in names]
            extra = [pa.array(counts.astype(np.int32))] if dropped else []
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, *(["_dropped"] if dropped else [])])

    made = arrow(joined, each, ddl(joined, *names) + (", _dropped int" if dropped else ""))
    return made.select(*[F.col(n).alias(c) for c, n in zip(docs.columns, names)], *([F.col("_dropped").alias(dropped)] if dropped else []))
