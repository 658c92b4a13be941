"""Held-out passages in training texts, by latent semantic retrieval and alignment.

1. Each document becomes the sequence of its words' numbers, once, from its whole text; case, punctuation and layout are
   gone, markup leaves words in between. The words of the held-out items have numbers of their own, all other words of the
   corpus share OTHER_WORDS numbers by hash: they take part in the latent space, but match no word of an item.
2. The latent space is the randomised singular value decomposition of the tf-idf matrix of all passages (PASSAGE words of
   a document). One pass counts passages by word and adds each passage, with a random sign, to one of RANK + SPARE rows;
   the rows' range is the trial space. A second pass sums the Gram products of all passages in it, whose leading vectors
   are the RANK directions kept. To them come the ITEM_RANK directions in which the items' own windows depart most from
   this space, found in the same way. Only sums travel, and they are added in two steps.
3. Every window of every document is compared with every window of the items by cosine in the latent space, both of unit
   length there. There is no test of shared words before it. A document that holds half of an item is close to half of its
   windows: a candidate is an item whose closest half of windows has a mean cosine of COSINE or more.
4. For each candidate the longest common subsequence of matching runs is found. It is cut into pieces where either side
   has a gap; short pieces, and pieces of less than LONG_WORDS words without a rare word, are shared phrases and don't
   count. A document holds a copy of an item if the pieces span at least half of the item's words.
5. A document that holds no copy of an item is a paraphrase of it if most of the item's windows have a close one in the
   document, in the corpus' MEANING_RANK leading directions, and the answer check holds: the document has at least the share
   ANSWERED of the telling words of the item's question and options.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.session import cut_lineage, share

BLOCK = 20
WINDOW, ITEM_STRIDE = 2 * BLOCK, 20
PASSAGE = 40
OTHER_WORDS = 8192
#: Words that no item has weigh by this factor: they stand for meaning only, and markup between an item's words is made of them.
OTHER_WEIGHT = 0.4
RANK, ITEM_RANK, SPARE = 128, 128, 16
COSINE = 0.7
#: A paraphrase: the leading directions of the corpus that count as meaning, the cosine that counts as close in them, the
#: share of the item's windows that must be, the share of its telling answer words.
MEANING_RANK, CLOSE, COVERED, ANSWERED = 32, 0.8, 0.6, 0.75
#: A word is rare if fewer than one in RARE passages of the corpus' pages holds it (passage k of all revisions of a page
#: counts once, so a page that is repeated or revised often makes no word common). In small corpora 0.6 of the largest
#: inverse frequency is enough.
RARE = 250
REGISTERS = 128
RUN = 3
PIECE_WORDS = 10
LONG_WORDS = 24
ITEM_GAP, DOC_GAP = 6, 20
HELD = 0.5
#: Items searched for in one pass over the encoded corpus, in characters; more take further passes over the encoded corpus.
PASS_CHARS = 20_000_000
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


@dataclass
class Vocabulary:
    """Numbers 1 to ``known`` are the items' words, those above them are shared by all other words."""

    number: dict[str, int]
    others: int = OTHER_WORDS

    @property
    def known(self) -> int:
        return len(self.number)

    @property
    def size(self) -> int:
        return self.known + self.others + 1

    @property
    def kind(self) -> str:
        return "<u2" if self.size <= 2**16 else "<u4"


def encoded(docs: DataFrame, vocabulary: Vocabulary, doc_id: str = "doc_id", text: str = "text", page: str | None = None) -> DataFrame:
    """``doc_id, page, codes``: the numbers of a text's words as little-endian integers; page is a hash of the document's
    page, or of its id where there is none."""
    shared = share(docs.sparkSession, vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared()
        seen: dict[str, int] = dict(v.number)
        for b in batches:
            codes = []
            for t in b["text"]:
                if len(seen) > 1_000_000:
                    seen = dict(v.number)
                found = words(t)
                numbers = list(map(seen.get, found))
                if None in numbers:
                    for w in found:
                        if w not in seen:
                            seen[w] = v.known + 1 + zlib.crc32(w.encode("utf-8", "replace")) % v.others
                    numbers = [seen[w] for w in found]
                codes.append(np.array(numbers, v.kind).tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"], "page": b["page"], "codes": codes})

    kind = dict(docs.dtypes)[doc_id]
    p = F.coalesce(F.xxhash64(page), F.xxhash64(doc_id)) if page in docs.columns else F.xxhash64(doc_id)
    p = F.when(F.col(page).isNull(), F.xxhash64(doc_id)).otherwise(p) if page in docs.columns else p
    rows = docs.select(F.col(doc_id).alias("doc_id"), p.alias("page"), F.col(text).alias("text")).where("text <> ''")
    return rows.mapInPandas(encode, f"doc_id {kind}, page long, codes binary")


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of 64-bit numbers."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def summed(parts: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """The sums of the arrays of ``row, part, sums`` by row (maxima for row -3), in two steps, so that no task adds more
    than about the square root of the number of parts."""

    def add(b: pd.DataFrame) -> pd.DataFrame:
        row, total = int(b["row"].iloc[0]), None
        for x in b["sums"]:
            x = np.frombuffer(x, np.uint8 if row == -3 else np.float64)
            total = x.copy() if total is None else np.maximum(total, x) if row == -3 else total + x
        return pd.DataFrame({"row": [row], "part": [int(b["part"].iloc[0]) // step], "sums": [total.tobytes()]})

    step = max(1, int(tasks**0.5))
    once = parts.groupBy("row", F.floor(F.col("part") / step)).applyInPandas(add, "row int, part int, sums binary")
    twice = once.groupBy("row").applyInPandas(add, "row int, part int, sums binary")
    return {r["row"]: np.frombuffer(r["sums"], np.uint8 if r["row"] == -3 else np.float64) for r in twice.collect()}


@dataclass
class Statistics:
    passages: int
    df: np.ndarray  # passages that hold each word
    page_share: np.ndarray  # share of the pages' passages that hold each of the items' words
    sketch: np.ndarray  # rows x words


def cardinality(registers: np.ndarray) -> np.ndarray:
    """Distinct hashes behind rows of registers (largest number of leading zeros + 1), with the small-range correction."""
    m = registers.shape[-1]
    raw = 0.7213 / (1 + 1.079 / m) * m * m / np.exp2(-registers.astype(float)).sum(-1)
    empty = (registers == 0).sum(-1)
    return np.where((raw <= 2.5 * m) & (empty > 0), m * np.log(m / np.maximum(empty, 1)), raw)


def corpus_statistics(codes: DataFrame, v: Vocabulary, rows: int = RANK + SPARE, seed: int = 7) -> Statistics:
    """One pass over all passages. Every task adds its passages up; what it hands on does not grow with them."""
    size, known = v.size, v.known

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, sketch, passages = np.zeros(size), np.zeros(rows * size), 0
        registers = np.zeros((known + 1) * REGISTERS, np.uint8)  # row 0 stands for all passages
        for b in batches:
            for i, page, raw in zip(b["doc_id"], b["page"], b["codes"]):
                c = np.frombuffer(raw, v.kind).astype(np.int64)
                if not len(c):
                    continue
                key, times = np.unique((np.arange(len(c)) // PASSAGE) * size + c, return_counts=True)
                p, w = key // size, key % size
                df += np.bincount(w, minlength=size)
                n = int(p[-1]) + 1
                passages += n
                salt = np.uint64(zlib.crc32(repr(i).encode()) + seed)
                h = mixed(np.arange(n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt)
                sign = np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
                np.add.at(sketch, (h % np.uint64(rows)).astype(np.int64)[p] * size + w, sign[p] * times)
                h = mixed(np.arange(n).astype(np.uint64) + np.uint64(page % 2**62))
                at = (h % np.uint64(REGISTERS)).astype(np.int64)
                zeros = (52 - np.floor(np.log2((h >> np.uint64(12)).astype(float) + 1))).astype(np.uint8)  # of 52 bits
                np.maximum.at(registers, at, zeros)
                own = w <= known
                np.maximum.at(registers, w[own] * REGISTERS + at[p[own]], zeros[p[own]])
        sums = [registers.tobytes(), np.array([float(passages)]).tobytes(), df.tobytes(), *(r.tobytes() for r in sketch.reshape(rows, size))]
        yield pd.DataFrame({"row": [-3, -2, -1, *range(rows)], "part": TaskContext.get().partitionId(), "sums": sums})

    by = summed(codes.mapInPandas(part, "row int, part int, sums binary"), codes.rdd.getNumPartitions())
    if not by:
        return Statistics(0, np.zeros(size), np.zeros(known + 1), np.zeros((rows, size)))
    distinct = cardinality(by[-3].reshape(known + 1, REGISTERS))
    page_share = np.minimum(1.0, distinct / max(1.0, distinct[0]))
    page_share[0] = 1.0
    return Statistics(int(by[-2][0]), by[-1], page_share, np.stack([by[k] for k in range(rows)]))


def projected(c: np.ndarray, basis: np.ndarray, step: int) -> np.ndarray:
    """The sums of the words' vectors over stretches of ``step`` words."""
    whole = len(c) // step
    out = np.empty((-(-len(c) // step), basis.shape[1]), basis.dtype)
    for a in range(0, whole, 500):  # bounds the memory of a long text
        b = min(whole, a + 500)
        np.sum(basis[c[a * step : b * step]].reshape(b - a, step, -1), axis=1, out=out[a:b])
    if len(out) > whole:
        out[whole] = basis[c[whole * step :]].sum(0)
    return out


def leading(gram: np.ndarray, rank: int) -> np.ndarray:
    """The eigenvectors of the largest eigenvalues, those of no weight left out."""
    values, vectors = np.linalg.eigh(gram)
    keep = np.argsort(-values, kind="stable")[:rank]
    return vectors[:, keep[values[keep] > 1e-9 * max(values.max(), 1e-300)]]


def corpus_space(codes: DataFrame, v: Vocabulary, s: Statistics, weight: np.ndarray, rank: int = RANK) -> np.ndarray:
    """words x rank: the leading right singular vectors of the tf-idf matrix of all passages, each of unit length."""
    both = s.sketch * weight
    if s.passages == 0 or not both.any():
        return np.zeros((v.size, 0))
    trial, _ = np.linalg.qr(both.T)
    shared = share(codes.sparkSession, ((trial * weight[:, None]).astype(np.float32), weight.astype(np.float32)))
    width = trial.shape[1]

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        basis, w = shared()
        gram = np.zeros((width, width))
        for b in batches:
            for raw in b["codes"]:
                c = np.frombuffer(raw, v.kind).astype(np.int64)
                if len(c):
                    length = np.add.reduceat(w[c] ** 2, np.arange(0, len(c), PASSAGE))
                    p = projected(c, basis, PASSAGE) / np.sqrt(length + 1e-12)[:, None]
                    gram += p.T @ p
        yield pd.DataFrame({"row": [0], "part": [TaskContext.get().partitionId()], "sums": [gram.tobytes()]})

    gram = summed(codes.mapInPandas(part, "row int, part int, sums binary"), codes.rdd.getNumPartitions())[0].reshape(width, width)
    return trial @ leading(gram, rank)


def item_windows(item_codes: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The windows of all items and the number of windows of each item."""
    cut = [[c[a : a + WINDOW] for a in range(0, max(1, len(c) - WINDOW + ITEM_STRIDE), ITEM_STRIDE)] for c in item_codes]
    return [w for ws in cut for w in ws], np.array([len(ws) for ws in cut], int)


def with_item_space(space: np.ndarray, windows: list[np.ndarray], weight: np.ndarray, rank: int = ITEM_RANK) -> np.ndarray:
    """The space with the directions in which the windows depart most from it. The same randomised decomposition, of the
    windows' tf-idf rows less their part in the space; a window is handled as its few words, so many items need no more
    memory than the sketch."""
    rows = rank + SPARE
    sketch = np.zeros((rows, len(weight)))
    h = mixed(np.arange(len(windows)) + 1)
    unit = []
    for k, c in enumerate(windows):
        w, times = np.unique(c, return_counts=True)
        x = times * weight[w]
        length = np.sqrt((x * x).sum())
        unit.append((w, x / length if length else x))
        sketch[int(h[k] % np.uint64(rows)), w] += unit[-1][1] * (1 if (h[k] >> np.uint64(40)) & np.uint64(1) else -1)
    sketch -= (sketch @ space) @ space.T
    if not sketch.any():
        return space
    trial, upper = np.linalg.qr(sketch.T)
    trial = trial[:, np.abs(np.diag(upper)) > 1e-9 * np.abs(upper).max()]
    p = np.stack([x @ trial[w] for w, x in unit])
    return np.concatenate([space, trial @ leading(p.T @ p, rank)], axis=1)


@dataclass
class Search:
    """What a task needs to search for one group of items."""

    basis: np.ndarray  # words x rank, with the words' weights
    windows: np.ndarray  # item windows x rank, of unit length
    own: np.ndarray  # items x windows: the windows of each item, -1 where it has no more
    items: list[np.ndarray]  # numbers of each item's words
    runs: list[np.ndarray]  # its runs of RUN words, in order
    tails: np.ndarray  # the telling words of the items' last lines, one after the other
    tail_first: np.ndarray  # where each item's begin
    tailless: np.ndarray  # whether it has none; a 0 stands there
    corpus: int  # directions of the space that come from the corpus
    ids: list
    rare: np.ndarray  # by word
    size: int
    cosine: float


def run_keys(c: np.ndarray, base: int) -> np.ndarray:
    """One number for each run of RUN words."""
    return sum(c[k : len(c) - RUN + 1 + k].astype(np.int64) * base ** (RUN - 1 - k) for k in range(RUN)) if len(c) >= RUN else np.empty(0, np.int64)


def fit(item_codes: list[np.ndarray], tails: list[np.ndarray], ids: list, space: np.ndarray, weight: np.ndarray, rare: np.ndarray, cosine: float = COSINE) -> Search:
    windows, counts = item_windows(item_codes)
    basis = (with_item_space(space, windows, weight) * weight[:, None]).astype(np.float32)
    at = np.stack([basis[c].sum(0) for c in windows])
    at /= np.linalg.norm(at, axis=1, keepdims=True) + 1e-9
    telling = [(t[rare[t]] if rare[t].any() else t) for t in map(np.unique, tails)]
    tailless = np.array([not len(t) for t in telling])
    telling = [t if len(t) else np.zeros(1, np.int64) for t in telling]
    lengths = np.array([len(t) for t in telling])
    place = np.arange(counts.max())
    own = np.where(place < counts[:, None], (np.cumsum(counts) - counts)[:, None] + place, -1)
    return Search(basis, at, own, item_codes, [run_keys(c, len(weight)) for c in item_codes], np.concatenate(telling), np.cumsum(lengths) - lengths, tailless, space.shape[1], ids, rare, len(weight), cosine)


def closeness(c: np.ndarray, s: Search, meaning: bool = False, of: np.ndarray | slice = slice(None)) -> np.ndarray:
    """For each window of the items (or those of ``of``) the largest cosine to a window of the document; with ``meaning`` in
    the leading directions of the corpus alone, where words that stand for each other lie together."""
    width = min(MEANING_RANK, s.corpus) if meaning else s.basis.shape[1]
    blocks = projected(c, s.basis[:, :width], BLOCK)
    q = blocks[:-1] + blocks[1:] if len(blocks) > 1 else blocks
    q /= np.linalg.norm(q, axis=1, keepdims=True) + 1e-9
    w = s.windows[of]
    w = w[:, :width] / (np.linalg.norm(w[:, :width], axis=1, keepdims=True) + 1e-9) if meaning else w
    best = np.full(len(w), -1.0, np.float32)
    for a in range(0, len(q), 1000):  # bounds the memory of a long text
        np.maximum(best, (q[a : a + 1000] @ w.T).max(0), out=best)
    return best


def judged(c: np.ndarray, s: Search, held: float) -> Iterator[tuple]:
    """(item id, held, covered, tail_held, kind) of the items that a document gives away."""
    if not len(c):
        return
    best = -np.sort(-np.append(closeness(c, s), -9)[s.own], axis=1)  # of each item its windows, closest first
    half = ((s.own >= 0).sum(1) + 1) // 2
    near = np.cumsum(best, axis=1)[np.arange(len(half)), half - 1] >= s.cosine * half
    words_ = np.zeros(s.size, bool)
    words_[c] = True
    tail = np.add.reduceat(words_[s.tails].astype(float), s.tail_first) / np.diff(np.append(s.tail_first, len(s.tails)))
    tail[s.tailless] = 0.0
    keys = np.unique(run_keys(c, s.size)) if near.any() else None
    for k in np.nonzero(near | (tail >= ANSWERED))[0].tolist():
        item, runs, got, own = s.items[k], s.runs[k], 0, s.own[k][s.own[k] >= 0]
        if near[k] and len(keys) and len(runs) and may_hold(keys[np.minimum(np.searchsorted(keys, runs), len(keys) - 1)] == runs, s.rare[item], held * len(item)):
            got = sum(y - x for x, y in pieces(item, c, s.rare, held * len(item)))
        copy = got >= held * len(item)
        if not copy and tail[k] < ANSWERED:
            continue
        covered = float((closeness(c, s, meaning=True, of=own) >= CLOSE).mean())
        if copy or covered >= COVERED:
            yield s.ids[k], got / len(item), covered, float(tail[k]), "copy" if copy else "paraphrase"


def pieces(item: np.ndarray, doc: np.ndarray, rare: np.ndarray, least: float = 0.0) -> list[tuple[int, int]]:
    """Stretches [a, b) of the item that the document holds, in order, by chained runs of matching words; none if they can't
    span ``least`` words.

    Runs are maximal diagonals of at least RUN matching words. The chain is the heaviest sequence of runs that rise in
    both texts; it is cut where more than ITEM_GAP words of the item or DOC_GAP of the document lie between two runs."""
    m, n = len(item), len(doc)
    if m < RUN or n < RUN:
        return []
    base = int(max(item.max(), doc.max())) + 1
    gi, gd = run_keys(item, base), run_keys(doc, base)
    order = np.argsort(gi, kind="stable")
    sorted_ = gi[order]
    lo, hi = np.searchsorted(sorted_, gd, "left"), np.searchsorted(sorted_, gd, "right")
    j = np.nonzero(hi > lo)[0]
    lo, hi = lo[j], hi[j]
    count = hi - lo
    if not count.sum():
        return []
    jj = np.repeat(j, count)
    ii = order[np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    by = np.lexsort((ii, jj - ii))
    ii, jj = ii[by], jj[by]
    new = np.ones(len(ii), bool)
    new[1:] = (jj[1:] - ii[1:] != jj[:-1] - ii[:-1]) | (ii[1:] != ii[:-1] + 1)
    start = np.nonzero(new)[0]
    length = np.diff(np.append(start, len(ii))) + RUN - 1
    runs = sorted(zip(ii[start].tolist(), jj[start].tolist(), length.tolist()), key=lambda r: (r[1], r[0]))
    ri, rq, rl = (np.array(x) for x in zip(*runs))
    # a short run that no other one can follow or precede within the gaps is a shared phrase, whatever the chain
    keep = rl >= PIECE_WORDS
    for a in range(0, len(ri), 1000):
        i, q, n_ = (x[a : a + 1000, None] for x in (ri, rq, rl))
        z = int(np.searchsorted(rq, (q + n_).max() + DOC_GAP, "right"))
        step_i, step_q = ri[None, a:z] - i - n_, rq[None, a:z] - q - n_
        joined = (step_i <= ITEM_GAP) & (step_q <= DOC_GAP) & (step_i + rl[a:z] > 0) & (step_q + rl[a:z] > 0) & (step_i > -n_) & (step_q > -n_)
        keep[a : a + 1000] |= joined.any(1)
        keep[a:z] |= joined.any(0)
    if not keep.all():
        ri, rq, rl = ri[keep], rq[keep], rl[keep]
        runs = [r for r, k in zip(runs, keep) if k]
    hit = np.zeros(m - RUN + 1, bool)
    for a, n_ in zip(ri.tolist(), rl.tolist()):
        hit[a : a + n_ - RUN + 1] = True
    if not may_hold(hit, rare[item], max(1.0, least)):
        return []
    best, back = rl.astype(float), np.full(len(runs), -1)
    for k in range(1, len(runs)):
        gap_i, gap_q = ri[k] - ri[:k] - rl[:k], rq[k] - rq[:k] - rl[:k]
        value = best[:k] + np.minimum(0, np.minimum(gap_i, gap_q)) - 0.5 * ((gap_i > ITEM_GAP) | (gap_q > DOC_GAP))
        value[(ri[:k] >= ri[k]) | (rq[:k] >= rq[k]) | (gap_i + rl[k] < 1) | (gap_q + rl[k] < 1)] = 0
        h = int(value.argmax())
        if value[h] > 0:
            best[k], back[k] = rl[k] + value[h], h
    k = int(np.argmax(best))
    chain = []
    while k >= 0:
        chain.append(runs[k])
        k = back[k]
    chain.reverse()
    out: list[list] = []  # first word, end, words that match, whether a rare word is among them
    last = None
    for i, q, length_ in chain:
        if last and i - last[0] <= ITEM_GAP and q - last[1] <= DOC_GAP:
            out[-1][2] += i + length_ - max(i, out[-1][1])
            out[-1][1] = i + length_
            out[-1][3] |= bool(rare[item[i : i + length_]].any())
        else:
            out.append([i, i + length_, length_, bool(rare[item[i : i + length_]].any())])
        last = (i + length_, q + length_)
    return [(a, b) for a, b, n, telling in out if (b - a >= PIECE_WORDS and telling) or (n >= LONG_WORDS and n >= 0.8 * (b - a))]


def may_hold(hit: np.ndarray, rare: np.ndarray, least: float) -> bool:
    """Whether pieces can span ``least`` words of an item, given which of its runs of RUN words stand in the document at
    all: the words of these runs, with gaps of up to ITEM_GAP words between them, are cut and measured like pieces."""
    at = np.nonzero(hit)[0]
    if len(at) * (RUN + ITEM_GAP) < least:
        return False
    last = np.append(np.diff(at) > RUN + ITEM_GAP, True)
    first = np.append(True, last[:-1])
    a, b = at[first], at[last] + RUN
    covered = np.zeros(len(hit) + RUN - 1, bool)
    for k in range(RUN):
        covered[at + k] = True
    sums = lambda x: np.append(0, np.cumsum(x))
    telling, matching = sums(covered & rare), sums(covered)
    span = b - a
    good = ((span >= PIECE_WORDS) & (telling[b] > telling[a])) | (matching[b] - matching[a] >= LONG_WORDS)
    return span[good].sum() >= least


def leaks(docs: DataFrame, items: DataFrame, cosine: float = COSINE, held: float = HELD, pass_chars: int = PASS_CHARS, page: str = "page_id") -> DataFrame:
    """``doc_id, item_id, held, covered, tail_held, kind``: the documents that give items away.

    kind is 'copy' if the document holds at least the share ``held`` of the item's words in its pieces, else 'paraphrase'
    (see above). covered is the share of the item's windows that are close to one of the document's, tail_held the share of
    the telling words of the item's last line (question and options) that the document has. Null and empty texts hold
    nothing; an item without words is never given away; items of equal text are found alike; a document that comes twice
    is reported twice. The corpus is encoded once. The items are a test set, which the driver reads; up to ``pass_chars``
    characters of them are searched for in one pass over the encoded corpus."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, held double, covered double, tail_held double, kind string"
    rows = items.where("item_id is not null and item_text <> ''").select("item_id", "item_text").orderBy("item_id").toPandas()
    split = [words(t) for t in rows["item_text"]]
    number: dict[str, int] = {}
    for w in split:
        for x in w:
            number.setdefault(x, len(number) + 1)
    keep = [k for k, w in enumerate(split) if w]
    if not keep:
        return spark.createDataFrame([], schema)
    v = Vocabulary(number)
    item_codes = [np.array([number[x] for x in split[k]], np.int64) for k in keep]
    tails = [np.array([number[x] for x in words(rows["item_text"].iloc[k].rstrip("\n").rpartition("\n")[2])], np.int64) for k in keep]
    codes = cut_lineage(encoded(docs, v, page=page))
    s = corpus_statistics(codes, v)
    weight = np.maximum(0, np.log((1 + s.passages + len(keep)) / (1 + s.df)))
    weight[0] = 0
    weight[v.known + 1 :] *= OTHER_WEIGHT
    inverse = np.zeros(v.size)
    inverse[1 : v.known + 1] = -np.log(np.maximum(s.page_share[1:], 1 / (1 + s.passages)))
    rare = inverse >= min(np.log(RARE), 0.6 * inverse.max())
    space = corpus_space(codes, v, s, weight)
    chars = rows["item_text"].str.len().to_numpy()
    passes = (np.cumsum(chars[keep]) - 1) // pass_chars
    out = None
    for number_ in np.unique(passes):
        mine = np.nonzero(passes == number_)[0].tolist()
        shared = share(spark, fit([item_codes[k] for k in mine], [tails[k] for k in mine], rows["item_id"].iloc[[keep[k] for k in mine]].tolist(), space, weight, rare, cosine))

        def find(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            search = shared()
            for b in batches:
                found = [(i, *r) for i, raw in zip(b["doc_id"], b["codes"]) for r in judged(np.frombuffer(raw, v.kind).astype(np.int64), search, held)]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "held", "covered", "tail_held", "kind"])

        part = codes.mapInPandas(find, schema)
        out = part if out is None else out.unionByName(part)
    return out
