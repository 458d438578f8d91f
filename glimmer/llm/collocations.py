"""Phrase collocations, mined by pivot partitioning.

Texts are lower-cased (A-Z) and cut at marks and line ends into pieces, pieces at blanks and tabs into words. All counts are
made within a language. The words of a language have one order, common words first: by a count sketch over all texts, then by
their bytes. A phrase belongs to its rarest word in that order, its pivot. From every place a text is rewritten to the fragments that
phrases beginning there lie in: one for each pivot that such phrases have, from that place up to the next rarer word, and no longer than
sketches of neighbours show that a phrase can be frequent. Equal fragments of a task become one with their number. Pivots fall
into ``GROUPS`` groups of a language, and each task sends a group one row with all that it has for its pivots. There the phrases
through these are counted, the beginnings of the fragments that reach their pivot, and nobody else counts them. A pivot with many
places is dealt out over several rows. A word alone is a
fragment of itself, and the empty phrase, with pivot '', occurs as often as there are words.

Sketches only order words and leave out what cannot be frequent, so counts are exact whatever falls together in them. Those of
neighbours have a bit for each cell and grow with the texts up to 2^``MOST_BITS`` cells for each number of words, the one of words
has a fixed size.

Null text is empty, null lang is 'und'. Repeated rows count each. Other columns are ignored. A text is held whole, with its
words, while it is cut. An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimmer.llm.common import fresh, give_back, join_spread, prepare, small, stage, text_or_empty
from glimmer.llm.shingles import forget, mix64, slice_hashes

#: Bytes of text that are cut into words together (a longer text on its own), rows that a task sums up before it sends them, rows
#: mined together, and rows of a batch that is handed to the JVM.
FLUSH, SUMMED, MINED, WRITTEN = 1 << 21, 1 << 18, 1 << 16, 1 << 13
#: Bits of a cell's number in the word sketch, and in those of neighbours, which have a cell for every CELL_BYTES of text.
WORD_BITS, LEAST_BITS, MOST_BITS, CELL_BYTES = 20, 20, 30, 16
#: Pieces in which a sketch is added up.
PIECE_BITS = 8
#: Groups of a language's pivots; places of a pivot, by the sketch, that stay together (more are dealt out).
GROUPS, PLACES = 1024, 1 << 20
#: Ways in which a language's phrases are dealt out before its best are found.
SPREAD = 64
#: Byte classes: A-Z to lower case, blank and tab to 32, marks and line ends to 10.
FOLD = np.array([10 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b in (9, 32) else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


@dataclass
class Words:
    """Words of a run of texts, in order: their bytes, piece and text, and which of the distinct ones each is."""

    body: np.ndarray
    edges: np.ndarray
    piece: np.ndarray
    doc: np.ndarray
    index: np.ndarray
    distinct: pa.Array


def strings_of(body: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(edges, np.int64)), pa.py_buffer(np.ascontiguousarray(body))])


def cut_words(texts: pa.Array) -> Words:
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    starts = at - at[0] + np.arange(len(at))  # of the texts, with a line end after each
    whole = np.full(len(data) + len(texts), 10, np.uint8)
    inside = np.ones(len(whole), bool)
    inside[starts[1:] - 1] = False
    whole[inside] = data
    whole = FOLD[whole]
    word = (whole != 10) & (whole != 32)
    change = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    first, last = change[::2], change[1::2]
    edges = np.concatenate(([0], np.cumsum(last - first)))
    body = whole[word]
    coded = strings_of(body, edges).dictionary_encode()
    return Words(body, edges, np.cumsum(whole == 10)[first], np.searchsorted(starts, first, side="right") - 1, coded.indices.to_numpy().astype(np.int64), coded.dictionary)


@dataclass
class Text:
    """A run of texts by language: ``own`` says which (language, word) each word is; of each of those language, word, number and hash."""

    words: Words
    langs: list[str]
    own: np.ndarray
    lang: np.ndarray
    word: np.ndarray
    n: np.ndarray
    hash: np.ndarray


def read_text(langs: pa.Array, texts: pa.Array) -> Text:
    w = cut_words(texts)
    coded = pc.fill_null(langs, "und").dictionary_encode()
    names, wide = coded.dictionary.to_pylist(), max(1, len(w.distinct))
    key, own, n = np.unique(coded.indices.to_numpy().astype(np.int64)[w.doc] * wide + w.index, return_inverse=True, return_counts=True)
    lang, word = key // wide, key % wide
    ends = np.frombuffer(w.distinct.buffers()[1], np.int64)[w.distinct.offset : w.distinct.offset + len(w.distinct) + 1] if len(w.distinct) else np.zeros(1, np.int64)
    data = np.frombuffer(w.distinct.buffers()[2] or b"", np.uint8) if len(w.distinct) else np.zeros(0, np.uint8)
    of_lang = mix64(np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names], np.uint64) + np.uint64(1))
    return Text(w, names, own, lang, word, n, mix64(slice_hashes(data, ends[:-1], ends[1:])[word] ^ of_lang[lang]) if len(key) else np.zeros(0, np.uint64))


def runs(batches):
    """(lang, text) columns in runs of about FLUSH bytes."""
    held, size = [], 0
    for rb in batches:
        lengths = pc.fill_null(pc.binary_length(rb.column(1)), 0).to_numpy(zero_copy_only=False)
        start = 0
        for k, n in enumerate(lengths.tolist(), 1):
            size += n
            if size >= FLUSH:
                held.append(rb.slice(start, k - start))
                yield tuple(pa.concat_arrays([h.column(c) for h in held]) for c in (0, 1))
                held, size, start = [], 0, k
        if start < rb.num_rows:
            held.append(rb.slice(start))
    if held:
        yield tuple(pa.concat_arrays([h.column(c) for h in held]) for c in (0, 1))


def next_gram(gram: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return mix64(gram[: len(gram) - 1] * np.uint64(0x9E3779B97F4A7C15) + (hashes ^ np.uint64(0xD6E8FEB86659FD93)))


def cell_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def packed(cells: np.ndarray, n: np.ndarray) -> bytes:
    """Ascending cells and their counts as byte planes: most bytes are zero."""
    both = np.stack((np.diff(cells, prepend=0), n)).astype("<u4")
    return zlib.compress(np.ascontiguousarray(both.view(np.uint8).reshape(2, -1, 4).transpose(0, 2, 1)).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, 4, -1).transpose(0, 2, 1)
    both = np.ascontiguousarray(planes).view("<u4")[:, :, 0].astype(np.int64)
    return np.cumsum(both[0]), both[1]


@dataclass
class Sketch:
    """Counts of words by cell; for each number of words from two on a bit for each cell that ``least`` or more phrases fall into;
    and one for each cell of a word that stands in such a pair."""

    words: np.ndarray
    grams: dict[int, np.ndarray]
    paired: np.ndarray | None
    bits: int

    def count(self, hashes: np.ndarray) -> np.ndarray:
        return self.words[cell_of(hashes, WORD_BITS)]

    def phrases_at(self, t: Text, longest: int):
        """For two words, three ...: hashes of the phrases that begin at each word but the last ones, and whether all shorter phrases in
        them may be frequent; the numbers of words of the sketch narrow that down from one to the next."""
        h = t.hash[t.own]
        gram, whole = h, np.ones(len(h), bool)
        for words in range(2, min(longest, len(h)) + 1):
            gram = next_gram(gram, h[words - 1 :])
            whole = whole[:-1] & whole[1:]
            if words == 2:
                whole &= t.words.piece[1:] == t.words.piece[:-1]
            yield words, gram, whole
            if words in self.grams:
                at = np.flatnonzero(whole)
                whole = whole.copy()
                whole[at] = bit(self.grams[words], cell_of(gram[at], self.bits))


def bit(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 > 0


def shipped_sketch(spark, s: Sketch):
    """A function that gives the sketch inside a task."""
    pack = lambda x: zlib.compress(x.tobytes(), 1)
    told = spark.sparkContext.broadcast((pack(s.words), {k: pack(v) for k, v in s.grams.items()}, None if s.paired is None else pack(s.paired)))
    bits = s.bits

    def read() -> Sketch:
        words, grams, paired = told.value
        back = lambda x: np.frombuffer(zlib.decompress(x), np.uint8)
        return Sketch(back(words).view("<u4"), {k: back(v) for k, v in grams.items()}, None if paired is None else back(paired), bits)

    return read


def in_slices(rb: pa.RecordBatch):
    for a in range(0, rb.num_rows, WRITTEN):
        yield rb.slice(a, WRITTEN)


def added_up(docs: DataFrame, kinds: list[tuple[int, int | None]], cells_of) -> list[np.ndarray]:
    """Sketches over all texts: ``kinds`` has the bits of a cell's number and the least sum that sets its bit (None: the sums themselves).

    ``cells_of()`` is made once a task; of a run it gives (ascending cells, counts) for each kind. Pieces are added up one after the other.
    """

    def count(batches):
        own = cells_of()
        for langs, texts in runs(batches):
            pieces, bodies = [], []
            for k, ((bits, _), (cells, n)) in enumerate(zip(kinds, own(read_text(langs, texts)), strict=True)):
                if not len(cells):
                    continue
                piece = cells >> (bits - PIECE_BITS)
                edge = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1]))).tolist()
                for a, b in zip(edge, [*edge[1:], len(cells)], strict=True):
                    pieces.append((k << PIECE_BITS) + int(piece[a]))
                    bodies.append(packed(cells[a:b] - (piece[a] << (bits - PIECE_BITS)), np.minimum(n[a:b], 0xFFFFFFFF)))
            for a in range(0, len(pieces), 64):
                yield pa.RecordBatch.from_arrays([pa.array(pieces[a : a + 64], pa.int32()), pa.array(bodies[a : a + 64], pa.binary())], ["piece", "body"])
            give_back()
        forget()

    def add(batches):
        """Sums of one piece after the other; rows come sorted by piece."""
        piece, total = None, None

        def done():
            least = kinds[piece >> PIECE_BITS][1]
            body = np.minimum(total, 0xFFFFFFFF).astype("<u4") if least is None else np.packbits(total >= least)
            return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([zlib.compress(body.tobytes(), 1)], pa.binary())], ["piece", "body"])

        for rb in batches:
            for k, body in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
                if k != piece:
                    if piece is not None:
                        yield done()
                    piece, total = k, np.zeros(1 << (kinds[k >> PIECE_BITS][0] - PIECE_BITS), np.int64)
                cells, n = unpacked(body)
                total[cells] += n
        if piece is not None:
            yield done()

    kind = "piece int, body binary"
    rows = docs.mapInArrow(count, kind).repartition("piece").sortWithinPartitions("piece").mapInArrow(add, kind).collect()
    out = [np.zeros(1 << bits, "<u4") if least is None else np.zeros(1 << (bits - 3), np.uint8) for bits, least in kinds]
    for r in rows:
        whole = out[r["piece"] >> PIECE_BITS].reshape(1 << PIECE_BITS, -1)
        whole[r["piece"] & ((1 << PIECE_BITS) - 1)] = np.frombuffer(zlib.decompress(r["body"]), whole.dtype)
    return out


def sketch(docs: DataFrame, least: int, longest: int) -> Sketch:
    """From all texts, which are read twice: words and pairs, then longer phrases of pairs that may be frequent.

    The driver receives its fixed number of cells: 2^WORD_BITS counts, and at most 2^MOST_BITS bits for each number of words.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MOST_BITS, max(LEAST_BITS, (size // CELL_BYTES).bit_length()))
    none = (np.zeros(0, np.int64),) * 2

    def words_and_pairs():
        nothing = Sketch(np.zeros(0), {}, None, bits)

        def cells(t: Text):
            order = np.argsort(t.hash)
            found, at = np.unique(cell_of(t.hash[order], WORD_BITS), return_index=True)
            pairs = [np.unique(cell_of(gram[whole], bits), return_counts=True) for _, gram, whole in nothing.phrases_at(t, 2)]
            return (found, np.add.reduceat(t.n[order], at) if len(at) else at), *(pairs or [none])

        return cells

    words, pairs = added_up(docs, [(WORD_BITS, None), (bits, least)], words_and_pairs)
    read = shipped_sketch(docs.sparkSession, Sketch(words, {2: pairs}, None, bits))

    def longer_and_paired():
        s = read()

        def cells(t: Text):
            found = {}
            linked = np.zeros(len(t.own), bool)
            for k, gram, whole in s.phrases_at(t, longest):
                if k == 2:
                    at = np.flatnonzero(whole)
                    at = at[bit(s.grams[2], cell_of(gram[at], bits))]
                    linked[at] = linked[at + 1] = True
                else:
                    found[k] = np.unique(cell_of(gram[whole], bits), return_counts=True)
            paired = np.unique(cell_of(t.hash[np.unique(t.own[linked])], bits))
            return (paired, np.ones(len(paired), np.int64)), *(found.get(k, none) for k in range(3, longest + 1))

        return cells

    paired, *longer = added_up(docs, [(bits, 1), *[(bits, least)] * max(0, longest - 2)], longer_and_paired)
    return Sketch(words, {2: pairs} | dict(enumerate(longer, 3)), paired, bits)


def fragments_of(t: Text, s: Sketch, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the pivot, the first and the last word of every fragment of a run.

    A fragment stands for the phrases that begin with its first word and end between its pivot and its last word.
    """
    by_bytes = np.empty(len(t.words.distinct), np.int64)
    by_bytes[pc.array_sort_indices(t.words.distinct).to_numpy()] = np.arange(len(by_bytes))
    rank = np.empty(len(t.hash), np.int64)
    rank[np.lexsort((by_bytes[t.word], -s.count(t.hash).astype(np.int64)))] = np.arange(len(rank))  # rarer is larger
    size = np.ones(len(t.own), np.int64)  # words of the longest phrase from each place that may be frequent
    for words, gram, whole in s.phrases_at(t, longest):
        at = np.flatnonzero(whole)
        at = at[bit(s.grams[words], cell_of(gram[at], s.bits))]
        size[at[size[at] == words - 1]] = words
    start = np.flatnonzero(size > 1)
    r, size = rank[t.own], size[start]
    pivot, out = start.copy(), []
    for k in range(1, longest):
        rarer = np.flatnonzero(size > k)
        rarer = rarer[r[start[rarer] + k] > r[pivot[rarer]]]
        if k > 1:
            out.append((pivot[rarer], start[rarer], start[rarer] + k - 1))
        pivot[rarer] = start[rarer] + k
    out.append((pivot, start, start + size - 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


FRAGMENT, PHRASE = ["lang", "pivot", "splits", "fragment"], ["lang", "phrase", "words"]
#: A row for a group of pivots: of each fragment its pivot, over how many rows that is dealt, and its number.
MESSAGE = ["lang", "group", "salt", "pivots", "splits", "fragments", "n"]


def summed(rows: list[pa.Table], keys: list[str], value: str) -> pa.Table:
    """Rows of equal keys as one, with the sum of their value."""
    out = pa.concat_tables(rows).group_by(keys).aggregate([(value, "sum")])
    return out.rename_columns([*keys, value] if out.column_names[0] == keys[0] else [value, *keys]).select([*keys, value])


def fragments(docs: DataFrame, s: Sketch, least: int, longest: int) -> DataFrame:
    """MESSAGE: for each group of pivots what a task has of fragments; docs: lang, text."""
    read = shipped_sketch(docs.sparkSession, s)

    def of_run(t: Text, s: Sketch):
        w, counts = t.words, s.count(t.hash)
        names, splits = pa.array(t.langs, pa.string()), 1 + counts.astype(np.int64) // PLACES

        def table(own, bodies, n):
            own = np.asarray(own)
            columns = [names.take(pa.array(t.lang[own])), w.distinct.take(pa.array(t.word[own])).cast(pa.string()), pa.array(splits[own], pa.int32()), bodies.cast(pa.string()), pa.array(n, pa.int64())]
            return pa.table(columns, names=[*FRAGMENT, "n"])

        total = np.bincount(t.lang, t.n, minlength=len(t.langs)).astype(np.int64)
        blank = pa.array([""] * len(names), pa.string())
        yield pa.table([names, blank, pa.array([1] * len(names), pa.int32()), blank, pa.array(total)], names=[*FRAGMENT, "n"])
        alone = np.flatnonzero((counts >= least) & bit(s.paired, cell_of(t.hash, s.bits)))
        yield table(alone, w.distinct.take(pa.array(t.word[alone])), t.n[alone])
        pivot, first, last = fragments_of(t, s, longest)
        body, edges = with_blanks(w)
        for a in range(0, len(pivot), SUMMED):
            own = t.own[pivot[a : a + SUMMED]]
            texts = slices(body, edges[first[a : a + SUMMED]], edges[last[a : a + SUMMED] + 1] - 1)
            same = pa.table({"own": pa.array(own), "body": texts}).group_by(["own", "body"]).aggregate([([], "count_all")])
            yield table(same.column("own").to_numpy(), same.column("body").combine_chunks(), same.column("count_all").to_numpy())

    def rewrite(batches):
        s = read()
        held, size = [], 0

        def sent(table):
            """A row for each group of pivots, and more for pivots that are dealt out."""
            table = table.sort_by([("lang", "ascending"), ("pivot", "ascending"), ("fragment", "ascending")]).combine_chunks()
            columns = {c: table.column(c).combine_chunks() for c in table.column_names}
            lang, pivot = (columns[c].dictionary_encode() for c in ("lang", "pivot"))
            group = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % GROUPS for x in pivot.dictionary.to_pylist()], np.int64)[pivot.indices.to_numpy()]
            keys = np.stack((lang.indices.to_numpy().astype(np.int64), group, np.arange(len(group)) % columns["splits"].to_numpy()))
            order = np.lexsort(keys[::-1])
            keys = keys[:, order]
            first = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
            edges = pa.array(np.append(first, len(order)), pa.int32())
            lists = [pa.ListArray.from_arrays(edges, columns[c].take(pa.array(order))) for c in ("pivot", "splits", "fragment", "n")]
            yield from in_slices(pa.RecordBatch.from_arrays([columns["lang"].take(pa.array(order[first])), pa.array(keys[1, first], pa.int32()), pa.array(keys[2, first], pa.int32()), *lists], MESSAGE))

        for langs, texts in runs(batches):
            for part in of_run(read_text(langs, texts), s):
                held.append(part)
                size += part.num_rows
            if size >= SUMMED:
                held = [summed(held, FRAGMENT, "n")]
                size = held[0].num_rows
                if size >= SUMMED // 2:  # little is alike
                    yield from sent(held[0])
                    held, size = [], 0
            give_back()
        if held:
            yield from sent(summed(held, FRAGMENT, "n"))
        forget()
        give_back()

    return docs.mapInArrow(rewrite, "lang string, group int, salt int, pivots array<string>, splits array<int>, fragments array<string>, n array<long>")


def with_blanks(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The words with a blank after each, and where they begin."""
    edges = w.edges + np.arange(len(w.edges))
    body, inside = np.full(int(edges[-1]), 32, np.uint8), np.ones(int(edges[-1]), bool)
    inside[edges[1:] - 1] = False
    body[inside] = w.body
    return body, edges


def slices(body: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """Copies of stretches of bytes."""
    cuts = np.concatenate(([0], np.cumsum(end - begin)))
    out = np.empty(int(cuts[-1]), np.uint8)
    for a in range(0, len(begin), WRITTEN):
        b = min(a + WRITTEN, len(begin))
        out[cuts[a] : cuts[b]] = body[np.repeat(begin[a:b] - cuts[a:b], end[a:b] - begin[a:b]) + np.arange(cuts[a], cuts[b])]
    return strings_of(out, cuts)


def mine(rows: pa.Table, longest: int, least: int) -> pa.Table:
    """Phrases through the pivots of some fragments: lang, group, splits, phrase, words, a. Rows are sorted by language and group, and of
    groups that lie wholly among them only the frequent phrases are kept."""
    frags = rows.column("fragment").combine_chunks()
    w = cut_words(frags)  # they are cut and folded: only blanks part them
    at, n = np.concatenate(([0], np.cumsum(np.bincount(w.doc, minlength=len(frags))))), rows.column("n").to_numpy()
    size = np.diff(at)
    pivots = pc.index_in(rows.column("pivot").combine_chunks().cast(pa.large_binary()), value_set=w.distinct).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    found = np.flatnonzero(w.index == pivots[w.doc])
    of, first = np.unique(w.doc[found], return_index=True)
    before = np.zeros(len(frags), np.int64)
    before[of] = found[first] - at[of]  # words before the pivot
    coded = rows.column("lang").combine_chunks().dictionary_encode()
    lang = coded.indices.to_numpy().astype(np.int64)
    own = rows.column("group").to_numpy()
    group = np.concatenate(([0], np.cumsum((lang[1:] != lang[:-1]) | (own[1:] != own[:-1]))))
    whole = (rows.column("splits").to_numpy() == 1) & (group > 0) & (group < group[-1])
    wide, owners_of, texts, lengths, totals = max(1, len(w.distinct)), [], [], [], []
    body, edges = with_blanks(w)
    for words in range(1, longest + 1):
        owner = np.flatnonzero((before < words) & (size >= words) & ((size == 1) if words == 1 else (size > 1)))
        start = at[owner]
        if not len(start):
            continue
        key, most = lang[owner], len(coded.dictionary)
        for k in range(words):
            if most > (1 << 62) // wide:
                ids, key = np.unique(key, return_inverse=True)
                most = len(ids)
            key, most = key * wide + w.index[start + k], most * wide
        order = np.argsort(key, kind="stable")
        key = key[order]
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total, one = np.add.reduceat(n[owner[order]], edge), order[edge]
        keep = (total >= least) | ~whole[owner[one]]
        total, one = total[keep], one[keep]
        owners_of.append(owner[one])
        texts.append(slices(body, edges[start[one]], edges[start[one] + words] - 1))
        lengths.append(np.full(len(one), words))
        totals.append(total)
    blank = np.flatnonzero(size == 0)
    at = pa.array(np.concatenate([*owners_of, blank]))
    text = pa.concat_arrays([*texts, pa.array([b""] * len(blank), pa.large_binary())]).cast(pa.string())
    columns = [rows.column(c).take(at) for c in ("lang", "group", "splits")]
    return pa.table([*columns, text, pa.array(np.concatenate([*lengths, np.zeros(len(blank))]), pa.int32()), pa.array(np.concatenate([*totals, n[blank]]), pa.int64())], names=["lang", "group", "splits", "phrase", "words", "a"])


def mined(batches, longest: int, least: int):
    """Phrases of the fragments of a task, sorted by language and group, as batches. Of a group that goes on in the next rows the phrases
    are held, and only the frequent ones are sent when it ends; pivots that are dealt out send all."""
    keys, held, size, opened = ["lang", "group", "splits", "phrase", "words"], [], 0, []

    def settle(last):
        """What can be sent after the rows held; ``last``: nothing more comes."""
        table = pa.Table.from_batches(held)
        now = (table.column("lang")[-1].as_py(), table.column("group")[-1].as_py())
        found = summed([*opened, mine(table, longest, least)], keys, "a")
        split = pc.greater(found.column("splits"), 1)
        goes_on = pc.and_(pc.and_(pc.equal(found.column("lang"), now[0]), pc.equal(found.column("group"), now[1])), pc.invert(split))
        goes_on = pc.and_(goes_on, pa.scalar(not last))
        good = pc.or_(pc.or_(split, pc.greater_equal(found.column("a"), least)), pc.equal(found.column("words"), 0))
        opened[:] = [found.filter(goes_on)]
        for rb in found.filter(pc.and_(good, pc.invert(goes_on))).select([*PHRASE, "a"]).combine_chunks().to_batches():
            yield from in_slices(rb)

    for rb in batches:
        of = pc.list_parent_indices(rb.column("fragments"))
        columns = {"lang": rb.column("lang").take(of), "group": rb.column("group").take(of)} | {name: rb.column(c).flatten() for name, c in (("pivot", "pivots"), ("splits", "splits"), ("fragment", "fragments"), ("n", "n"))}
        held.append(pa.RecordBatch.from_arrays(list(columns.values()), list(columns)))
        size += held[-1].num_rows
        if size >= MINED:
            yield from settle(False)
            held, size = [], 0
            give_back()
    if held:
        yield from settle(True)
    elif opened:
        table = opened[0]
        for rb in table.filter(pc.greater_equal(table.column("a"), least)).select([*PHRASE, "a"]).combine_chunks().to_batches():
            yield from in_slices(rb)
    give_back()


def phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> DataFrame:
    """lang, phrase, words, a: every phrase of up to ``longest`` words that occurs ``least`` times or more, and the empty one; staged."""
    prepare(docs.sparkSession)
    thin = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().alias("text"))
    rows = fragments(thin, sketch(thin, least, longest), least, longest)

    def count(batches):
        yield from mined(batches, longest, least)

    dealt = rows.repartition("lang", "group", "salt").sortWithinPartitions("lang", "group")
    found = dealt.mapInArrow(count, "lang string, phrase string, words int, a long")
    total = found.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a"))
    return stage(total.where((F.col("a") >= least) | (F.col("words") == 0)), "phrases")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, inside: int = 100) -> DataFrame:
    """Each language's first ``top`` phrases of two and more words: lang, rank, phrase, a, l, r, n, score.

    score is floor(1000 a n / (l r)) of the lowest-scoring cut into a first part (l) and a rest (r). Phrases go whose words lie in a
    longer one with at least ``inside`` hundredths of their occurrences. Best scores first, then most occurrences, then by bytes.
    """
    every = phrases(docs, least, longest)
    n = stage(every.where("words = 0").select("lang", F.col("a").alias("n")), "phrase-words")
    found = every.where("words > 1")
    # what a longer phrase holds occurs no less than that phrase does, so it is enough to look one word further
    edge = lambda c: found.where("words > 2").select("lang", c.alias("phrase"), F.col("a").alias("longer"))
    longer = edge(F.expr("substring_index(phrase, ' ', words - 1)")).unionByName(edge(F.expr("substring_index(phrase, ' ', 1 - words)")))
    longer = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = found.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a"))).drop("longer")
    cuts = kept.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = stage(cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("rest")), "phrase-cuts")
    part = lambda name, value: every.where("words > 0").select("lang", F.col("phrase").alias(name), F.col("a").alias(value))
    cuts = stage(join_spread(cuts, part("first", "l"), ["lang", "first"]), "phrase-first").drop("first")
    cuts = join_spread(cuts, part("rest", "r"), ["lang", "rest"]).join(small(n), "lang")
    score = F.expr("cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(18,0)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    best = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    best = best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = fresh(best, "salt")
    dealt = best.withColumn(salt, F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order)))
    some = dealt.where(F.col("rank") <= top).drop("rank", salt)  # at most SPREAD * top rows of a language
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
