"""Benchmark passages in documents, by latent semantic retrieval.

Passages of all documents and of the benchmark are rows of a TF-IDF matrix over the
benchmark's terms. One pass over the corpus sums a random sketch of its term-by-term
product and counts each term's passages; a randomised decomposition of the sketch gives
the latent space. A second pass projects every window of every document and compares it
with all items by cosine. What comes near is verified on the words themselves: weighted
longest common subsequence, and whether the item's answer is there. Items that stand in a
document word for word are looked up as well, so they are found however light their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import doc_texts, text_buffer

# The ends of sentences, by which an item's answer is told from its question.
SENTENCE_ENDS = (ord("."), ord("?"), ord("!"), ord("\n"))


@dataclass(frozen=True)
class Settings:
    """``block`` items are searched at a time; a window has ``window`` words and begins every ``step`` words.

    A window is a candidate for an item from ``cosine`` on, if it has ``mass`` of the
    item's length in the latent space. A match has ``share`` of the item's weight in
    common, or ``share_answered`` and the answer. Words in more than ``common`` of the
    items do not span the space, except where a part has no other words. Verbatim parts are
    looked up by their first ``lookup`` words and then compared whole. A text of more than
    ``bytes_at_once`` is gone through in segments, and ``products`` cosines are taken at a time. ``window`` is a multiple of ``step``.
    """

    block: int = 2000
    window: int = 64
    step: int = 16
    rank: int = 64
    sketch: int = 80
    cosine: float = 0.2
    mass: float = 0.4
    share: float = 0.7
    share_answered: float = 0.55
    common: float = 0.1
    lookup: int = 4
    seed: int = 11
    bytes_at_once: int = 1 << 18
    products: int = 1 << 19

    @property
    def segment(self) -> int:
        """Words of a segment of a long text: whole windows, whole steps."""
        unit = self.window * self.step
        return unit * max(1, self.bytes_at_once // (8 * unit))

    def windows(self, words: np.ndarray) -> np.ndarray:
        """How many windows texts of so many words have."""
        return np.where(words > 0, np.maximum(0, -(-(words - self.window) // self.step)) + 1, 0)


# ---------------------------------------------------------------- words of a buffer

_CLASS = np.zeros(256, np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _CLASS[_b] = _b
for _b in range(65, 91):
    _CLASS[_b] = _b + 32
_TABLE = np.random.default_rng(5).integers(0, 1 << 64, 64 << 8, dtype=np.uint64)


def hashed_words(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, owner and place in ``body`` of every word (letters, digits and signs beyond ASCII; A-Z as a-z)."""
    if len(body) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sign = _CLASS[body]
    on = sign > 0
    begins = on.copy()
    begins[1:] &= ~on[:-1]
    heads = offsets[:-1][offsets[:-1] < len(body)]
    begins[heads] = on[heads]
    start = np.flatnonzero(begins)
    if len(start) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = start[0]
    at = np.arange(first, len(body)) - np.repeat(start, np.diff(np.append(start, len(body))))
    value = _TABLE[(at & 63) << 8 | sign[first:]]
    value[~on[first:]] = 0
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
    return np.add.reduceat(value, start - first), owner, start


def _chunks(batch: pa.RecordBatch, at_once: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of parts of the batch's last column, each of whole texts."""
    body, offsets = text_buffer(batch.column(batch.num_columns - 1))
    row, rows = 0, len(offsets) - 1
    while row < rows:
        past = max(row + 1, int(np.searchsorted(offsets, offsets[row] + at_once, "right")) - 1)
        yield row, body[offsets[row] : offsets[past]], offsets[row : past + 1] - offsets[row]
        row = past


def hashed_pieces(body: np.ndarray, at_once: int) -> Iterator[np.ndarray]:
    """Hashes of the words of one text, ``at_once`` bytes at a time; a word may be longer than that."""
    value, length = np.uint64(0), 0  # of a word that began in an earlier piece
    for begin in range(0, len(body), at_once):
        piece = body[begin : begin + at_once]
        if length:
            sign = _CLASS[piece]
            ends = np.flatnonzero(sign == 0)
            more = int(ends[0]) if len(ends) else len(piece)
            value = np.append(_TABLE[(np.arange(length, length + more) & 63) << 8 | sign[:more]], value).sum(dtype=np.uint64)
            length += more
            if more == len(piece):
                continue
            yield np.array([value])
            piece, length = piece[more:], 0
        hashes, _, place = hashed_words(piece, np.array([0, len(piece)]))
        if len(hashes) and _CLASS[piece[-1]]:
            value, length = hashes[-1], len(piece) - int(place[-1])
            hashes = hashes[:-1]
        yield hashes
    if length:
        yield np.array([value])


# ---------------------------------------------------------------- benchmark


@dataclass(frozen=True)
class Part:
    """A window of an item's words, or all of a shorter item's; ``answer`` counts those of its last sentence."""

    item: int
    words: np.ndarray  # places in the vocabulary
    answer: int


@dataclass(frozen=True)
class Benchmark:
    vocabulary: np.ndarray  # sorted hashes
    spans: np.ndarray  # is the term of the latent space?
    parts: tuple[Part, ...]

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary; -1 for other words."""
        shift, heads, deepest = self._slots
        at, found = heads[hashes >> shift], np.full(len(hashes), -1)
        for n in range(deepest):
            probe = np.minimum(at + n, len(self.vocabulary) - 1)
            found = np.where(self.vocabulary[probe] == hashes, probe, found)
        return found

    @cached_property
    def _slots(self) -> tuple[np.uint64, np.ndarray, int]:
        """The vocabulary by the first bits of its hashes: where each slot begins, and how many the fullest has."""
        bits = len(self.vocabulary).bit_length() + 3
        shift = np.uint64(64 - bits)
        counts = np.bincount(self.vocabulary >> shift, minlength=1 << bits)
        return shift, np.cumsum(counts) - counts, int(counts.max())


def prepare(items: list[tuple[int, str]], settings: Settings = Settings()) -> Benchmark | None:
    """Terms and passages of the items; None if no item has a word."""
    found = []
    for item, text in sorted(items):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        hashes, _, place = hashed_words(raw, np.array([0, len(raw)]))
        if len(hashes):
            ends = np.flatnonzero(np.isin(raw, SENTENCE_ENDS))
            inner = ends[ends < place[-1]]  # ends with a word after them
            answer = int((place > inner[-1]).sum()) if len(inner) else 0
            found.append((item, hashes, answer))
    if not found:
        return None
    vocabulary, count = np.unique(np.concatenate([np.unique(h) for _, h, _ in found]), return_counts=True)
    spans = count <= max(5, settings.common * len(found))
    parts = []
    for item, hashes, answer in found:
        terms = np.searchsorted(vocabulary, hashes)
        for at in range(0, len(terms), settings.window):
            last = at + settings.window >= len(terms)
            # the last part overlaps the one before: a few words alone would match any text that has them
            at = max(0, len(terms) - settings.window) if last else at
            piece = terms[at : at + settings.window]
            parts.append(Part(item, piece, min(answer, len(piece)) if last else 0))
    bare = [p.words for p in parts if not spans[p.words].any()]
    if bare:
        spans[np.concatenate(bare)] = True
    return Benchmark(vocabulary, spans, tuple(parts))


@dataclass(frozen=True)
class Segment:
    """Terms of some whole texts, or of a part of one long text and the words around it.

    ``counts`` and ``windows`` are those of each text, the first text in ``row``. ``base``
    words of a long text come before; the first ``lead`` of the terms and those after ``own``
    more belong to other segments, which have the windows that begin there.
    """

    row: int
    terms: np.ndarray
    counts: np.ndarray
    windows: np.ndarray
    base: int = 0
    lead: int = 0
    own: int | None = None


def _segments(batch: pa.RecordBatch, bench: Benchmark, settings: Settings) -> Iterator[Segment]:
    for row, body, offsets in _chunks(batch, settings.bytes_at_once):
        if len(body) <= settings.bytes_at_once:
            hashes, owner, _ = hashed_words(body, offsets)
            counts = np.bincount(owner, minlength=len(offsets) - 1)
            yield Segment(row, bench.terms(hashes), counts, settings.windows(counts))
            continue
        pieces = hashed_pieces(body, settings.bytes_at_once)
        terms = np.concatenate([bench.terms(h).astype(np.int32) for h in pieces])
        size, windows = settings.segment, settings.windows(np.array([len(terms)]))
        for at in range(0, len(terms), size):
            low, high = max(0, at - settings.step), min(len(terms), at + size + settings.window + settings.step)
            own = np.clip(windows - at // settings.step, 0, size // settings.step)
            yield Segment(row, terms[low:high].astype(np.int64), np.array([high - low]), own, low, at - low, size)


# ---------------------------------------------------------------- latent space


def _sketched(terms: np.ndarray, passage: np.ndarray, bench: Benchmark, omega: np.ndarray, df: np.ndarray, g: np.ndarray) -> None:
    """Add passages to the counts ``df`` and to ``g``, the sketch of the product of the term matrix with itself."""
    if len(terms) == 0:
        return
    pairs, tf = np.unique(passage * len(bench.vocabulary) + terms, return_counts=True)
    term, owner = pairs % len(bench.vocabulary), pairs // len(bench.vocabulary)
    df += np.bincount(term, minlength=len(df))
    use = bench.spans[term]
    term, owner, weight = term[use], owner[use], (1 + np.log(tf[use])).astype(np.float32)
    if len(term) == 0:
        return
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    rows = np.add.reduceat(omega[term] * weight[:, None], begins, axis=0)
    order = np.argsort(term, kind="stable")
    sorted_terms = term[order]
    back = rows[np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(owner))))[order]] * weight[order, None]
    first = np.flatnonzero(np.append(True, sorted_terms[1:] != sorted_terms[:-1]))
    g[sorted_terms[first]] += np.add.reduceat(back, first, axis=0)


def _omega(bench: Benchmark, settings: Settings) -> np.ndarray:
    return np.random.default_rng(settings.seed).normal(size=(len(bench.vocabulary), settings.sketch)).astype(np.float32)


def _sketcher(bench: Benchmark, settings: Settings):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        omega = _omega(bench, settings)
        df, g, passages = np.zeros(len(omega), np.int64), np.zeros(omega.shape, np.float64), 0
        for batch in batches:
            for part in _segments(batch, bench, settings):
                terms, counts = part.terms, part.counts
                if part.own is not None:
                    terms = terms[part.lead : part.lead + part.own]
                    counts = np.array([len(terms)])
                owner = np.repeat(np.arange(len(counts)), counts)
                nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                per = -(-counts // settings.window)
                passage = (np.cumsum(per) - per)[owner] + nth // settings.window
                passages += int(per.sum())
                _sketched(terms[terms >= 0], passage[terms >= 0], bench, omega, df, g)
        seen = np.flatnonzero(df)
        columns = [pa.array(g[seen, j]) for j in range(settings.sketch)]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[seen]), *columns], ["term", "df", *_names(settings)])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([passages]), *[pa.array([0.0])] * settings.sketch], ["term", "df", *_names(settings)])

    return sketch


def _names(settings: Settings) -> list[str]:
    return [f"g{j}" for j in range(settings.sketch)]


@dataclass(frozen=True)
class Space:
    weight: np.ndarray  # inverse passage frequency of each term
    basis: np.ndarray  # terms x rank, weighted
    items: np.ndarray  # parts x rank


def fit(texts: DataFrame, bench: Benchmark, settings: Settings = Settings()) -> Space:
    """The latent space, from all passages of ``texts`` and of the benchmark.

    Each task sums its passages; a row for each term of the benchmark and each task is
    shuffled, a row for each term reaches the driver.
    """
    names = _names(settings)
    ddl = "term bigint, df bigint, " + ", ".join(f"{n} double" for n in names)
    sums = texts.mapInArrow(_sketcher(bench, settings), ddl).groupBy("term").agg(F.sum("df").alias("df"), *[F.sum(n).alias(n) for n in names])
    table = sums.toArrow()
    omega = _omega(bench, settings)
    size = len(omega)
    term = table.column("term").to_numpy()
    df, g = np.zeros(size + 1, np.int64), np.zeros((size + 1, settings.sketch))
    df[term] = table.column("df").to_numpy()
    g[term] = np.stack([table.column(n).to_numpy() for n in names], axis=1) if len(term) else 0
    passages, df, g = max(1, df[-1]), df[:-1], g[:-1]
    # the benchmark's own passages, with the corpus's weight in all
    own_df, own = np.zeros(size, np.int64), np.zeros((size, settings.sketch))
    words = np.concatenate([p.words for p in bench.parts])
    owner = np.repeat(np.arange(len(bench.parts)), [len(p.words) for p in bench.parts])
    _sketched(words, owner, bench, omega, own_df, own)
    g = g / max(1e-12, np.linalg.norm(g)) + own / max(1e-12, np.linalg.norm(own))
    weight = np.log((1 + passages + len(bench.parts)) / (1 + df + own_df)) + 0.01
    scaled = np.where(bench.spans, weight, 0)
    sketch = scaled[:, None] * g
    core = omega.T @ g
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    use = values > 1e-9 * max(values.max(initial=0), 1e-12)
    left, _, _ = np.linalg.svd(sketch @ (vectors[:, use] / np.sqrt(values[use])), full_matrices=False)
    basis = (scaled[:, None] * left[:, : settings.rank]).astype(np.float32)
    items = np.stack([basis[p.words].sum(axis=0) for p in bench.parts])
    return Space(weight.astype(np.float32), basis, items)


# ---------------------------------------------------------------- search

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _runs(terms: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` terms from each place on, as far as there are so many."""
    known = terms.astype(np.uint64)
    places = max(0, len(terms) - size + 1)
    value = np.zeros(places, np.uint64)
    for n in range(size):
        value = value * _FACTOR + known[n : n + places] + np.uint64(1)
    return value


class Lookup:
    """Places where parts stand word for word."""

    def __init__(self, parts: tuple[Part, ...], size: int):
        self.parts = parts
        by_size: dict[int, dict[int, list[int]]] = {}
        for n, part in enumerate(parts):
            head = min(size, len(part.words))
            by_size.setdefault(head, {}).setdefault(int(_runs(part.words[:head], head)[0]), []).append(n)
        self.heads = {head: (np.array(sorted(keys), np.uint64), keys) for head, keys in by_size.items()}

    def found(self, terms: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(document, place, part): the first place of a part in each document that has it."""
        for head, (keys, parts) in self.heads.items():
            values = _runs(terms, head)
            at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
            hits = np.flatnonzero(keys[at] == values)
            order = hits[np.argsort(at[hits], kind="stable")]
            for group in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []:
                for p in parts[int(keys[at[group[0]]])]:
                    words = self.parts[p].words
                    whole = group[group + len(words) <= len(terms)]
                    whole = whole[owner[whole] == owner[whole + len(words) - 1]]
                    for n, word in enumerate(words):
                        whole = whole[terms[whole + n] == word]
                    docs, first = np.unique(owner[whole], return_index=True)
                    yield from ((int(d), int(whole[i]), p) for d, i in zip(docs, first))


def common_share(item: np.ndarray, region: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Weight of the longest common subsequence as a share of the item's, and the places of the region in it."""
    own = weight[item]
    rows = [np.zeros(len(item) + 1)]
    inside = np.flatnonzero(np.isin(region, item))
    for at in inside:
        before = rows[-1]
        taken = np.where(item == region[at], before[:-1] + own, 0)
        rows.append(np.append(0, np.maximum.accumulate(np.maximum(before[1:], taken))))
    used, j = [], len(item)
    for i in range(len(inside), 0, -1):
        while j and rows[i][j] == rows[i][j - 1]:
            j -= 1
        if j and rows[i][j] > rows[i - 1][j]:
            used.append(inside[i - 1])
            j -= 1
    return min(1.0, float(rows[-1][-1] / max(1e-12, own.sum()))), np.array(used[::-1], np.int64)


def _verified(part: Part, region: np.ndarray, space: Space, settings: Settings) -> tuple[float, bool, np.ndarray] | None:
    share, used = common_share(part.words, region, space.weight)
    if share < min(settings.share, settings.share_answered):
        return None
    answered = part.answer > 0 and common_share(part.words[len(part.words) - part.answer :], region, space.weight)[0] >= 0.8
    if share >= settings.share or answered:
        return share, answered, used
    return None


MATCH = "doc_id bigint, item_id bigint, first_word bigint, past_word bigint, cosine double, common_share double, answer_found boolean"


def _searcher(bench: Benchmark, space: Space, settings: Settings):
    lookup = Lookup(bench.parts, settings.lookup)
    length = np.linalg.norm(space.items, axis=1)
    length = np.where(length > 0, length, np.inf).astype(np.float32)
    # what each term can add to a common subsequence at most, and what is needed
    most = [{int(t): float(n * space.weight[t]) for t, n in zip(*np.unique(p.words, return_counts=True))} for p in bench.parts]
    needed = [min(settings.share, settings.share_answered) * sum(m.values()) * (1 - 1e-5) for m in most]

    least = settings.mass * length**2
    across = settings.window // settings.step
    at_once = max(1, settings.products // len(bench.parts))

    def candidates(segment: Segment):
        """(document, first word, part, cosine) of the windows that come near a part; cosines are rounded, so equal ones tie."""
        terms, counts, per = segment.terms, segment.counts, segment.windows
        heads = np.cumsum(counts) - counts
        # the basis is summed over steps of words; after each text stand empty steps
        steps = -(-counts // settings.step) + across - 1
        begin = np.cumsum(steps) - steps
        place = np.flatnonzero((terms >= 0) & bench.spans[terms])
        doc = np.repeat(np.arange(len(counts)), counts)[place]
        at = begin[doc] + (place - heads[doc]) // settings.step
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
        sums, filled = np.zeros((int(steps.sum()), space.basis.shape[1]), np.float32), np.zeros(int(steps.sum()), bool)
        if len(at):
            sums[at[first]] = np.add.reduceat(space.basis[terms[place]], first, axis=0)
            filled[at[first]] = True
        owner = np.repeat(np.arange(len(counts)), per)
        nth = segment.lead // settings.step + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
        bucket = begin[owner] + nth
        some = np.flatnonzero(np.logical_or.reduce([filled[bucket + n] for n in range(across)]))
        for low in range(0, len(some), at_once):
            rows = some[low : low + at_once]
            vectors = sums[bucket[rows]]
            for n in range(1, across):
                vectors += sums[bucket[rows] + n]
            dots = vectors @ space.items.T
            i, part = np.divmod(np.flatnonzero(dots >= least), len(least))
            cosine = dots[i, part] / (np.linalg.norm(vectors[i], axis=1) * length[part])
            near = cosine >= settings.cosine
            i, part, cosine = rows[i[near]], part[near], np.round(cosine[near].astype(np.float64), 4)
            start = heads[owner[i]] + nth[i] * settings.step
            yield from zip(owner[i].tolist(), start.tolist(), part.tolist(), cosine.tolist())

    def cosine_at(terms: np.ndarray, p: int) -> float:
        """Cosine of a part and the passage of ``terms``."""
        inside = terms[terms >= 0]
        vector = space.basis[inside[bench.spans[inside]]].sum(axis=0)
        return float(vector @ space.items[p] / max(1e-12, np.linalg.norm(vector) * length[p]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            # by row and item: the best window, and the first place where a part stands word for word
            best: dict[tuple[int, int], tuple] = {}
            placed: dict[tuple[int, int], tuple] = {}
            for segment in _segments(batch, bench, settings):
                terms, counts, base = segment.terms, segment.counts, segment.base
                heads = np.cumsum(counts) - counts
                ends, count = np.cumsum(counts).tolist(), counts.tolist()
                found: dict[tuple[int, int], list] = {}
                present: dict[tuple[int, int], set] = {}
                for doc, start, p, cosine in candidates(segment):
                    found.setdefault((doc, bench.parts[p].item), []).append((-cosine, start, p))
                for (doc, item), windows in found.items():
                    low, high, key = ends[doc] - count[doc], ends[doc], (segment.row + doc, item)
                    for minus, start, p in sorted(windows):
                        rank = (minus, start - low + base, p)
                        if key in best and best[key][0] <= rank:
                            break
                        a, b = max(low, start - settings.step), min(high, start + settings.window + settings.step)
                        if (a, b) not in present:
                            present[a, b] = set(terms[a:b].tolist())
                        if sum(map(most[p].__getitem__, most[p].keys() & present[a, b])) < needed[p]:
                            continue
                        if seen := _verified(bench.parts[p], terms[a:b], space, settings):
                            share, answered, used = seen
                            first, past = (int(a + used[n] - low + base) for n in (0, -1))
                            best[key] = rank, (first, past + 1, min(1.0, -minus), share, answered)
                            break
                for doc, at, p in lookup.found(terms, np.repeat(np.arange(len(counts)), counts)):
                    part = bench.parts[p]
                    key, first = (segment.row + doc, part.item), int(at - heads[doc] + base)
                    if key not in best and (key not in placed or (first, p) < placed[key][0]):
                        near = cosine_at(terms[at : min(heads[doc] + counts[doc], at + settings.window)], p)
                        row = first, first + len(part.words), max(-1.0, min(1.0, near)), 1.0, part.answer > 0
                        placed[key] = (first, p), row
            out = [(ids[row], item, *values) for (row, item), (_, values) in (placed | best).items()]
            columns = list(zip(*out)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            names = ["doc_id", "item_id", "first_word", "past_word", "cosine", "common_share", "answer_found"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return search


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, first_word, past_word, cosine, common_share, answer_found): items found in documents.

    A row of ``docs`` and an item that match give one row, with the best window; the words
    are counted from 0. Null and empty texts match nothing; rows that repeat, also with one
    number, each have their own matches; a null number stays null. Very long texts are searched
    whole, segment by segment; only their words' places in the vocabulary are held at once.
    Without documents or items there are no rows. Items with one number are one item; null
    numbers are left out. The benchmark is searched block by block, so what is sent to the
    tasks is bounded by ``block`` items.
    """
    texts = doc_texts(docs)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").filter("item_id is not null and text is not null")
    blocks = -(-items.count() // settings.block)
    found = None
    for n in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n).collect()
        bench = prepare([(r["item_id"], r["text"]) for r in rows], settings)
        if bench is not None:
            block = texts.mapInArrow(_searcher(bench, fit(texts, bench, settings), settings), MATCH)
            found = block if found is None else found.union(block)
    return found if found is not None else docs.sparkSession.createDataFrame([], MATCH)


def op4_decontamination(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents that hold an item of the benchmark, with the item and the place; all cases as in ``matches``."""
    return matches(docs, benchmark, settings)


def decontamination_stage(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows whose text holds no item, with all their columns.

    Documents are told apart by a hash of number and text, so that only hashes meet the
    list of those that go.
    """
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")))
    keyed = docs.select(key.alias("doc_id"), "text")
    gone = matches(keyed, benchmark, settings).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, key == F.col("__gone"), "left_anti")
