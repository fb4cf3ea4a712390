"""Repeated substrings by recompression.

Words get fingerprints for names. Each round names maximal runs of one symbol, then pairs of
a left symbol and a right one (a symbol's side is a bit of its name). Names are made from
what they stand for, so they agree everywhere without an exchange, and equal substrings have
the same symbols inside but for their ends. With each symbol goes the span of words that
forced it (its context): a window that holds the context holds the symbol in every text.

A window of w words is known by the highest symbols it holds: the one of least name is its
anchor. Equal windows have equal anchors at equal places, so windows need to be compared
only where an anchor's context stands more than once. One round tells which anchors' names
several batches have. In another the windows of those, and no others, are compared by their
whole fingerprints, with the anchor's name and its place; they are dealt by fingerprint, so
a passage that a third of all texts hold makes no hot key. The earliest of equal windows
stays, and the words of all others are removed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.common import gram_hashes, mix, span_hashes, spans, utf8, word_hashes, words
from weftspark.llm.rounds import ask, differences, keep_rows, kept_rows, known, squeeze, stretch

#: Rounds of renaming, words in a window, bits of an anchor's name that are exchanged.
ROUNDS, WINDOW, BITS = 2, 20, 56


class Symbols:
    """A level of the parse: names, words from ``begin`` to ``end``, contexts from ``low`` to ``high``."""

    def __init__(self, name: np.ndarray, text: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        self.name, self.text, self.begin, self.end, self.low, self.high = name, text, begin, end, low, high

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of the symbols before and after; past a text's end lies a word that no window holds."""
        n = len(self.name)
        starts, ends = np.ones(n, bool), np.ones(n, bool)
        starts[1:] = ends[:-1] = self.text[1:] != self.text[:-1]
        before = np.where(starts, self.low - 1, np.roll(self.low, 1))
        after = np.where(ends, self.high + 1, np.roll(self.high, -1))
        return starts, ends, before, after

    def take(self, first: np.ndarray, last: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
        return Symbols(name, self.text[first], self.begin[first], self.end[last], low, high)

    def runs(self) -> Symbols:
        """Maximal runs as one symbol. That a run is maximal takes both neighbours to know."""
        n = len(self.name)
        if not n:
            return self
        starts, _, before, after = self.neighbours()
        starts[1:] |= self.name[1:] != self.name[:-1]
        first = np.flatnonzero(starts)
        last = np.append(first[1:], n) - 1
        count = (last - first + 1).astype(np.uint64)
        name = np.where(count > 1, mix(self.name[first] + count * np.uint64(0xD6E8FEB86659FD93)), self.name[first])
        return self.take(first, last, name, np.minimum(before[first], self.low[first]), np.maximum(after[last], self.high[last]))

    def pairs(self, level: int) -> Symbols:
        """Left symbols that a right one follows, as one symbol with it."""
        n = len(self.name)
        if not n:
            return self
        right = mix(self.name + np.uint64(0xA0761D6478BD642F + 2 * level)) >> np.uint64(63) == 1
        _, ends, before, after = self.neighbours()
        joined = np.zeros(n, bool)
        joined[:-1] = ~right[:-1] & right[1:] & ~ends[:-1]
        second = np.roll(joined, 1)
        first = np.flatnonzero(~second)
        last = first + joined[first]
        name = np.where(joined[first], mix(self.name[first] * np.uint64(0xE7037ED1A0B428DB) + (self.name[last] ^ np.uint64(level + 1))), self.name[first])
        low = np.where(right[first], np.minimum(before[first], self.low[first]), self.low[first])
        high = np.where(joined[first], self.high[last], np.maximum(after[first], self.high[first]))
        return self.take(first, last, name, low, high)


def parse(h: np.ndarray, at: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """The levels of a batch of texts, words first; ``at`` has the texts' n + 1 word offsets."""
    place = np.arange(len(h), dtype=np.int32)
    level = Symbols(h, np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at)), place, place + 1, place, place + 1)
    out = [level]
    for k in range(rounds):
        out.append(out[-1].runs().pairs(k))
    return out


def anchors(h: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Name of each window's anchor, by the window's first word; and which windows there are."""
    name, _, valid = anchored(h, at, window)
    return name, valid


def anchored(h: np.ndarray, at: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name of each window's anchor and its place in the window, by the window's first word; and which windows there are.

    Equal windows have equal anchors at equal places; windows that overlap often share one.
    """
    n = len(h)
    valid = np.zeros(n, bool)
    for_text = np.maximum(np.diff(at) - window + 1, 0)
    owner, within = spans(for_text)
    valid[at[owner] + within] = True
    levels = parse(h, at)
    named, offset = np.zeros(n, np.uint64), np.zeros(n, np.uint8)
    left = valid.copy()
    for depth in range(len(levels) - 1, 0, -1):
        s = levels[depth]
        use = np.flatnonzero(s.high - s.low <= window)
        if depth < len(levels) - 1:
            # Only symbols that some window still needs.
            total = np.concatenate([[0], np.cumsum(left)])
            a, b = np.maximum(s.high[use] - window, 0), np.minimum(s.low[use], n - 1)
            use = use[(b >= a) & (total[np.minimum(b + 1, n)] > total[np.minimum(a, n)])]
        if not len(use):
            continue
        low, high = s.low[use], s.high[use]
        # Ranks are by name, then place.
        by = np.argsort(s.name[use], kind="stable")
        rank = np.empty(len(use), np.int64)
        rank[by] = np.arange(len(use))
        best = np.full(n, len(use), np.int64)
        for t in range(window - int((high - low).min()) + 1):
            w = high - window + t
            ok = np.flatnonzero((w <= low) & (w >= 0) & (w < n))
            np.minimum.at(best, w[ok], rank[ok])
        got = np.flatnonzero(left & (best < len(use)))
        i = use[by[best[got]]]
        lo, size = s.low[i].astype(np.int64), (s.high[i] - s.low[i]).astype(np.int64)
        shape = (s.begin[i] - lo).astype(np.uint64) * np.uint64(8) + np.uint64(depth)
        named[got] = mix(span_hashes(h, lo, size) + shape)
        offset[got] = lo - got
        left[got] = False
    rest = np.flatnonzero(left)
    for i in range(0, len(rest), 1 << 18):
        w = rest[i : i + (1 << 18)]
        block = h[w[:, None] + np.arange(window)]
        k = np.argmin(block, axis=1)
        named[w] = mix(block[np.arange(len(w)), k])
        offset[w] = k
    return named, offset, valid


def _words(batch: pa.RecordBatch, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a batch's words, and the n + 1 offsets of the texts' words."""
    raw, offsets = utf8(batch.column(texts))
    starts, ends, at = words(raw, offsets)
    return word_hashes(raw, starts, ends), at


def _keep(batch: pa.RecordBatch, ids: int) -> bytes:
    """A batch in the order of its ids, as a blob."""
    key = batch.column(ids).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    return keep_rows(batch.take(pa.array(np.argsort(key, kind="stable"))))


def _scatter(batch: pa.RecordBatch, ranges: int, ids: int, texts: int) -> tuple[bytes, dict[int, bytes]]:
    """First round: the names of a batch's anchors, each once."""
    name, valid = anchors(*_words(batch, texts))
    names = np.unique(name[valid] >> np.uint64(64 - BITS))
    cuts = np.searchsorted(names // np.uint64(-(-(1 << BITS) // ranges)), np.arange(ranges + 1, dtype=np.uint64))
    return known(b"", _keep(batch, ids)), {i: squeeze(differences(names[cuts[i] : cuts[i + 1]])) for i in range(ranges) if cuts[i + 1] > cuts[i]}


def _shared(blobs: list[bytes]) -> list[bytes | None]:
    """For each batch, those of its names that another batch has too."""
    if not blobs:
        return []
    names = [np.cumsum(stretch(b)[0]) for b in blobs]
    every = np.concatenate(names)
    by = np.argsort(every, kind="stable")
    same = every[by[1:]] == every[by[:-1]]
    many = np.zeros(len(every), bool)
    many[by[1:]] |= same
    many[by[:-1]] |= same
    cuts = np.cumsum([0, *map(len, names)])
    return [squeeze(differences(own[many[a:b]])) if many[a:b].any() else None for own, a, b in zip(names, cuts[:-1], cuts[1:], strict=True)]


def _windows(kept: bytes, answers: list[bytes], ranges: int, ids: int, texts: int) -> tuple[bytes, dict[int, bytes]]:
    """Second round: the windows whose anchors another batch has, dealt by their prints, so a common anchor is no common key."""
    batch = kept_rows(kept)
    h, at = _words(batch, texts)
    name, offset, valid = anchored(h, at)
    w = np.flatnonzero(valid)
    name, offset, print_ = name[w], offset[w], gram_hashes(h, WINDOW, 17)[w]
    # Of equal windows in the batch only the earliest asks; the others are known to be repeats.
    whole = mix(name ^ print_)
    by = np.argsort(whole, kind="stable")
    again = np.zeros(len(w), bool)
    again[by[1:]] = whole[by[1:]] == whole[by[:-1]]
    covered = w[again]
    name = name >> np.uint64(64 - BITS)
    wanted = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(stretch(a)[0]) for a in answers)]))
    asks = ~again
    if len(wanted):
        asks &= wanted[np.minimum(np.searchsorted(wanted, name), len(wanted) - 1)] == name
    else:
        asks[:] = False
    w, print_, text = w[asks], print_[asks], np.searchsorted(at, w[asks], "right") - 1
    # The anchor's name and its place in the window, as 32 bits beside the print.
    check = (name[asks] * np.uint64(WINDOW) + offset[asks]) & np.uint64(0xFFFFFFFF)
    key = batch.column(ids).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
    ids_blob = np.ascontiguousarray(key).view(np.uint64) + np.uint64(1 << 63)
    to = (print_ >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    order = np.argsort(to, kind="stable")
    cuts = np.searchsorted(to[order], np.arange(ranges + 1, dtype=np.uint64))
    sent = {}
    for i in range(ranges):
        own = order[cuts[i] : cuts[i + 1]]
        if len(own):
            rows, inverse = np.unique(text[own], return_inverse=True)
            sent[i] = squeeze(differences(inverse), w[own] - at[text[own]], print_[own], check[own], rows, differences(ids_blob[rows]))
    row = np.searchsorted(at, covered, "right") - 1
    return known(squeeze(covered - at[row], row), kept), sent


def _reduce(blobs: list[bytes]) -> list[bytes | None]:
    """For each batch, the places and rows of those of its windows that stand earlier."""
    if not blobs:
        return []
    columns: tuple[list, ...] = ([], [], [], [], [])
    for blob in blobs:
        row, place, print_, check, rows, ids = stretch(blob)
        row = np.cumsum(row).astype(np.int64)
        for c, v in zip(columns, (rows[row].astype(np.uint32), place.astype(np.uint32), print_, check.astype(np.uint32), np.cumsum(ids)[row]), strict=True):
            c.append(v)
    own = np.repeat(np.arange(len(blobs), dtype=np.uint32), [len(x) for x in columns[0]])
    row, place, print_, check, doc = (np.concatenate(c) for c in columns)
    del columns
    order = np.lexsort((place, own, doc, check, print_))
    later = np.zeros(len(order), bool)
    later[1:] = (print_[order[1:]] == print_[order[:-1]]) & (check[order[1:]] == check[order[:-1]])
    repeats = np.sort(order[later])
    cuts = np.searchsorted(own[repeats], np.arange(len(blobs) + 1))
    return [squeeze(place[mine], row[mine]) if len(mine) else None for mine in (repeats[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))]


def remove_repeats(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", rejoin: bool = False) -> DataFrame:
    """All rows and columns, the text without repeated words, with ``n_words`` and ``n_removed``.

    A word goes if a window of WINDOW words that covers it stands earlier too: in a row of
    smaller id, or in the same text before. Words are runs of other than ASCII white space.
    Where some go, those kept are joined by single spaces; other texts stay as they are
    unless ``rejoin``. A null text has no word and stays null, an empty one stays empty; a very
    long one is a batch of its own. Rows of one id count as different texts, the one read first
    being earlier; null ids are smallest. An empty table stays empty. Columns named n_words or
    n_removed are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    ids, texts = own.index(id_column), own.index(text_column)
    rows = docs.select(*own)

    def gather(kept: bytes, answers: list[bytes]) -> pa.Table:
        size = _frame(kept)
        local, batch = stretch(kept[:size]), kept_rows(kept[size:])
        raw, offsets = utf8(batch.column(texts))
        starts, ends, at = words(raw, offsets)
        change = np.zeros(len(starts) + 1, np.int32)
        for place, row in [local, *map(stretch, answers)]:
            w = at[row.astype(np.int64)] + place.astype(np.int64)
            np.add.at(change, w, 1)
            np.add.at(change, w + WINDOW, -1)
        keep = np.cumsum(change[:-1]) == 0
        data = raw.tobytes()
        out, gone = [], []
        isnull = batch.column(texts).is_null().to_numpy(zero_copy_only=False)
        for i in range(batch.num_rows):
            a, b = at[i], at[i + 1]
            k = np.flatnonzero(keep[a:b]) + a
            if len(k) == b - a and not rejoin:  # nothing goes, so the text stays as it is
                out.append(None if isnull[i] else data[offsets[i] : offsets[i + 1]].decode())
                gone.append(0)
                continue
            out.append(b" ".join([data[x:y] for x, y in zip(starts[k].tolist(), ends[k].tolist(), strict=True)]).decode())
            gone.append(int(b - a - len(k)))
        columns = [pa.array(out, pa.string()) if c == texts else batch.column(c) for c in range(batch.num_columns)]
        return pa.table([*columns, pa.array(np.diff(at).astype(np.int64)), pa.array(gone, pa.int64())], names=[*own, "n_words", "n_removed"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
    again = [(lambda kept, answers, r: _windows(kept, answers, r, ids, texts), _reduce)]
    return ask(rows, text_column, lambda b, r: _scatter(b, r, ids, texts), _shared, gather, ", ".join([*fields, "n_words long", "n_removed long"]), further=again, keep=lambda b: _keep(b, ids))


def _frame(blob: bytes) -> int:
    """Bytes of the compressed frame that a blob begins with."""
    import zstandard

    d = zstandard.ZstdDecompressor().decompressobj()
    d.decompress(blob)
    return len(blob) - len(d.unused_data)


def digest(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    out = remove_repeats(docs.select(id_column, "text"), id_column=id_column, rejoin=True)
    return out.select(id_column, "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
