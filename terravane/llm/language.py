"""Language of documents and of their mixed segments, by prediction by partial matching.

For each language a variable-order tree of byte contexts is counted from labelled texts: after the (at most ORDER) bytes
before it within a word, a byte costs -log2 of its share; a byte unseen after a context costs an escape and is coded
after the next shorter context, at last evenly. The statistics are frozen, so a word's exact code length in every
language is a fixed number, and each distinct word is coded once per task. A sentence's code length is the sum over
its words; sentences are the segments, and a cheapest path over them decides where the language changes.

The trees are fitted on a bounded sample of labelled rows (TRAIN_DOCS a language); sentences of the sample that another
language's tree codes better are then left out, as are words that few texts hold, and the trees fitted anew, so that
wrong labels, mixed texts and gibberish in the sample do no harm. Every document is scored, whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.session import cut_lineage, share

LANGUAGES = ("de", "en", "es", "fr", "it", "nl", "pl", "pt", "ru")
ORDER = 5
TRAIN_DOCS = 300
#: Texts of the sample have between these numbers of characters, which bounds what the driver reads of them.
TRAIN_CHARS, TRAIN_MOST_CHARS = 60, 20_000
TRAIN_ROUNDS = 2
#: Words that a smaller share of a language's sampled texts hold (names, slips, vandalism) are left out of its tree.
TRAIN_SUPPORT = 0.01
LEAST_WORDS = 25
#: Bits that a change of language between two sentences costs.
SWITCH_BITS = 24.0
#: A sentence that costs more bits a letter than this in every language is not prose.
PROSE_BITS = 5.0
SENTENCE_WORDS = 4
CACHE_WORDS = 400_000

#: Three-letter codes and English names of the languages, and marks of an absent label.
CODES = {
    "deu": "de", "ger": "de", "german": "de", "eng": "en", "english": "en", "spa": "es", "spanish": "es", "fra": "fr", "fre": "fr", "french": "fr",
    "ita": "it", "italian": "it", "nld": "nl", "dut": "nl", "dutch": "nl", "pol": "pl", "polish": "pl", "por": "pt", "portuguese": "pt", "rus": "ru", "russian": "ru",
}
ABSENT = ("", "und", "undefined", "undetermined", "unknown", "n/a", "na", "none", "null", "nan", "-", "--", "?", "??", "xx", "xxx", "zxx", "mul", "mis")


def label_code(label: Column) -> Column:
    """The two-letter code that a label stands for; null if absent; other languages' labels in lower case as they are."""
    x = F.lower(F.trim(label))
    base = F.regexp_extract(x, r"^([a-z]+)(?:[-_].*)?$", 1)
    base = F.when((base == "") | x.isin(*ABSENT), x).otherwise(base)
    named = F.coalesce(*[F.when(base == k, F.lit(v)) for k, v in CODES.items()], base)
    return F.when(label.isNotNull() & ~x.isin(*ABSENT), named)


_DROP = [re.compile(p, re.S | re.I) for p in (r"<!--.*?-->", r"<ref[^<>]*/>", r"<ref\b[^<>]*>.*?</ref>", r"<(nowiki|pre|math|code|gallery|syntaxhighlight)\b[^<>]*>.*?</\1>")]
_INLINE = re.compile(r"\{\{\s*(?:lang|abbr|nowrap|small|tooltip)\s*\|([^{}|]*)(?:\|[^{}]*)?\}\}", re.I)
_PARAMETER = re.compile(r"\{\{\{[^{}]*\}\}\}")
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_TABLE = re.compile(r"^[ \t]*\{\|.*?^[ \t]*\|\}", re.S | re.M)
_SPECIAL = re.compile(r"\[\[[^\[\]|:]{2,20}:[^\[\]]*\]\]")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_URL = re.compile(r"\[?(?:https?:)?//\S+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&[a-z]+;|'{2,}|__[A-Z]+__")
_LINE = re.compile(r"^[ \t]*(?:=.*=|[|!{}].*|#redirect.*)[ \t]*$", re.M | re.I)
_SENTENCE = re.compile(r"(?<=[.!?…])[\s\"»”)]+|\n+")
_LETTERS = re.compile(r"[^\W\d_]+")


def prose(text: str) -> str:
    """The text without markup, templates, tables, headings, references and redirects; links and inline words stay."""
    if "<" in text:
        for p in _DROP:
            text = p.sub(" ", text)
    if "{" in text:
        text = _TABLE.sub("\n", text)
        text = _INLINE.sub(r"\1", text)
        text = _PARAMETER.sub("", text)
        n = 1
        while n:  # from the innermost outwards
            text, n = _TEMPLATE.subn("", text)
    if "[" in text:
        text = _LINK.sub(r"\1", _SPECIAL.sub("", text))
    if "//" in text:
        text = _URL.sub(" ", text)
    text = _TAG.sub("", text)
    return _LINE.sub("", text)


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words of each sentence of the prose; sentences of fewer than SENTENCE_WORDS words are left out."""
    if not text:
        return []
    found = (_LETTERS.findall(s) for s in _SENTENCE.split(prose(text).lower()))
    return [w for w in found if len(w) >= SENTENCE_WORDS]


def _coded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of ' word ' for all words, the word of each byte and its place in it."""
    raw = [b" " + w.encode("utf-8", "replace") + b" " for w in words]
    lengths = np.array([len(r) for r in raw], np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(raw)), lengths)
    return data, word, np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _contexts(data: np.ndarray, place: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with ``order`` bytes before them in their word, and the number of that context."""
    at = np.nonzero((place >= order) & (place > 0))[0]
    number = np.full(len(at), order, np.int64)
    for k in range(order, 0, -1):
        number = number * 256 + data[at - k]
    return at, number


@dataclass
class Trees:
    """Frozen code lengths by language: of a byte after a context (NaN where unseen), and of the escape from it."""

    order: int
    keys: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def cost(self, words: list[str]) -> np.ndarray:
        """words x languages: exact code lengths in bits."""
        data, word, place = _coded(words)
        total = np.zeros((len(data), len(LANGUAGES)), np.float32)
        open_ = np.zeros((len(data), len(LANGUAGES)), bool)
        open_[place > 0] = True
        for o in range(self.order, -1, -1):
            at, context = _contexts(data, place, o)
            if not len(at) or not len(self.keys[o]):
                continue
            key = context * 256 + data[at]
            k = np.minimum(np.searchsorted(self.keys[o], key), len(self.keys[o]) - 1)
            bits = np.where((self.keys[o][k] == key)[:, None], self.bits[o][k], np.nan)
            c = np.minimum(np.searchsorted(self.contexts[o], context), len(self.contexts[o]) - 1)
            escape = np.where((self.contexts[o][c] == context)[:, None], self.escapes[o][c], 0)
            seen = ~np.isnan(bits)
            total[at] += np.where(open_[at], np.where(seen, bits, escape), 0)
            open_[at] &= ~seen
        total += 8.0 * open_
        out = np.zeros((len(words), len(LANGUAGES)), np.float32)
        np.add.at(out, word, total)
        return out


def grow(counts: list[Counter], order: int = ORDER) -> Trees:
    """Trees from the words' counts of each language (one Counter each, in the order of LANGUAGES)."""
    words = sorted(set().union(*counts))
    weights = np.array([[c[w] for c in counts] for w in words], float).reshape(len(words), len(counts))
    data, word, place = _coded(words) if words else (np.empty(0, np.int64),) * 3
    t = Trees(order, [], [], [], [])
    for o in range(order + 1):
        at, context = _contexts(data, place, o)
        key, inverse = np.unique(context * 256 + data[at], return_inverse=True)
        n = np.stack([np.bincount(inverse, weights[word[at], k], len(key)) for k in range(len(counts))], 1) if len(key) else np.empty((0, len(counts)))
        parent, inside = np.unique(key // 256, return_inverse=True)
        total = np.stack([np.bincount(inside, n[:, k], len(parent)) for k in range(len(counts))], 1) if len(key) else n
        kinds = np.stack([np.bincount(inside, n[:, k] > 0, len(parent)) for k in range(len(counts))], 1) if len(key) else n
        with np.errstate(divide="ignore", invalid="ignore"):
            bits = np.where(n > 0, -np.log2(n / (total + kinds)[inside]), np.nan) if len(key) else n
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
        t.keys.append(key), t.bits.append(bits.astype(np.float32)), t.contexts.append(parent), t.escapes.append(escape.astype(np.float32))
    return t


class Coder:
    """Code lengths of sentences, with each distinct word coded once as long as the memory of words holds it."""

    def __init__(self, trees: Trees):
        self.trees, self.place, self.table = trees, {}, np.empty((0, len(LANGUAGES)), np.float32)

    def word_costs(self, words: list[str]) -> np.ndarray:
        if len(self.place) > CACHE_WORDS:
            self.place, self.table = {}, self.table[:0]
        new = [w for w in dict.fromkeys(words) if w not in self.place]
        for first in range(0, len(new), 20_000):
            part = new[first : first + 20_000]
            self.place.update(zip(part, range(len(self.place), len(self.place) + len(part))))
            self.table = np.concatenate([self.table, self.trees.cost(part)])
        place = self.place
        return self.table[[place[w] for w in words]]

    def sentence_costs(self, docs: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For all sentences of all documents: document, words, letters, bits by language."""
        flat = [s for d in docs for s in d]
        n = np.array([len(s) for s in flat], np.int64)
        doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        if not len(flat):
            return doc, n, n, np.empty((0, len(LANGUAGES)), np.float32)
        words = [w for s in flat for w in s]
        starts = np.cumsum(n) - n
        letters = np.add.reduceat(np.array([len(w) + 1 for w in words], np.int64), starts)
        return doc, n, letters, np.add.reduceat(self.word_costs(words), starts, axis=0)


def path(bits: np.ndarray, switch: float = SWITCH_BITS) -> np.ndarray:
    """The cheapest sequence of languages over a document's sentences."""
    first = bits.argmin(1)
    if (first == first[0]).all():
        return first
    cost, back = bits[0].copy(), np.empty(bits.shape, np.int64)
    for k in range(1, len(bits)):
        j = int(cost.argmin())
        stay = cost <= cost[j] + switch
        back[k] = np.where(stay, np.arange(bits.shape[1]), j)
        cost = np.where(stay, cost, cost[j] + switch) + bits[k]
    out = np.empty(len(bits), np.int64)
    out[-1] = cost.argmin()
    for k in range(len(bits) - 1, 0, -1):
        out[k - 1] = back[k, out[k]]
    return out


def train(docs: DataFrame, per_language: int = TRAIN_DOCS, least_chars: int = TRAIN_CHARS, most_chars: int = TRAIN_MOST_CHARS) -> Trees:
    """Trees from about ``per_language`` labelled texts of each language of ``least_chars`` to ``most_chars`` characters, one
    of a page, those of least hash. The pages are found in one scan without the texts, which a second one fetches."""
    code = label_code(F.col("lang"))
    h = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1_000_000))
    fit = docs.select(code.alias("code"), F.coalesce("page_id", "doc_id").alias("page"), "doc_id", h.alias("h")).where(F.col("code").isin(*LANGUAGES) & F.col("n_chars").between(least_chars, most_chars))
    pages = fit.groupBy("page").agg(F.min(F.struct("h", "doc_id", "code")).alias("x")).select("x.*")
    pages = cut_lineage(pages)
    total = {r["code"]: r["count"] for r in pages.groupBy("code").count().collect()}
    # hashes of the pages' first rows crowd near 0, so the share is taken of a second hash
    share = F.element_at(F.create_map(*[x for c, n in (total or {"": 1}).items() for x in (F.lit(c), F.lit(min(1.0, per_language / n)))]), F.col("code"))
    picked = pages.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000).select("doc_id", "code")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("code", "text").collect()
    return purified([(LANGUAGES.index(r["code"]), sentences(r["text"])) for r in rows])


def purified(sample: list[tuple[int, list[list[str]]]], rounds: int = TRAIN_ROUNDS, support: float = TRAIN_SUPPORT) -> Trees:
    """Trees from (language, sentences) of texts. A word counts by the texts of a language that hold it, from a share of
    ``support`` on, at least two. Each round leaves out the sentences that the trees of the round before code better in
    another language."""
    label = np.array([k for k, ss in sample for _ in ss], np.int64)
    keep = np.ones(len(label), bool)
    for r in range(rounds + 1):
        counts, texts, at = [Counter() for _ in LANGUAGES], Counter(), 0
        for k, ss in sample:
            own = [s for s, ok in zip(ss, keep[at : at + len(ss)]) if ok]
            at += len(ss)
            texts[k] += bool(own)
            counts[k].update({w for s in own for w in s})
        least = [max(2, support * texts[k]) for k in range(len(LANGUAGES))]
        trees = grow([Counter({w: n for w, n in c.items() if n >= m}) for c, m in zip(counts, least)])
        if r == rounds or not len(label):
            return trees
        _, _, _, bits = Coder(trees).sentence_costs([ss for _, ss in sample])
        keep = bits.argmin(1) == label


def segments(docs: DataFrame, trees: Trees, switch: float = SWITCH_BITS, prose_bits: float = PROSE_BITS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, code, segment, language, first, last, words, sentences, confidence, languages, language_words, again``: for
    each document one row with segment 0 for the whole, and from segment 1 on one for each run of a language along its
    sentences.

    code is the document's own label (null if absent); languages says how many languages of the document have at least
    ``least_words`` words in all, language_words how many words the row's language has in the document, and again whether an
    earlier run has this language. first and last number the run's sentences in ``sentences(text)`` from 0, where those that
    are not prose count and can lie within a run; words and sentences count the prose only. The whole has the language
    with most words, its first and last prose sentence, and all its prose sentences. confidence is the share of the language
    in the likelihood of those sentences, from their exact code lengths, evened out to one sentence's weight. Null, empty and
    markup-only texts and gibberish have just the row of the whole, with a null language; a row that comes twice is judged
    twice."""
    shared = share(docs.sparkSession, trees)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(shared())
        for whole in batches:
            for first in range(0, len(whole), 500):
                b = whole.iloc[first : first + 500]
                doc, n, letters, bits = coder.sentence_costs([sentences(t) for t in b["text"]])
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                good = bits.min(1) <= prose_bits * letters if len(bits) else np.empty(0, bool)
                doc, n, bits, place = doc[good], n[good], bits[good], place[good]
                out = []
                starts = np.searchsorted(doc, np.arange(len(b) + 1))
                for id_, code, a, z in zip(b["doc_id"].tolist(), b["code"].tolist(), starts[:-1], starts[1:]):
                    if a == z:
                        out.append((id_, code, 0, None, None, None, 0, 0, None, 0, 0, False))
                        continue
                    lang = path(bits[a:z], switch)
                    words = np.bincount(lang, n[a:z], len(LANGUAGES))
                    several = int((words >= least_words).sum())
                    cuts = np.flatnonzero(np.diff(lang)) + 1
                    runs = list(zip([0, *cuts], [*cuts, z - a]))
                    had = set()
                    for segment, (u, v) in enumerate([(0, z - a), *runs]):
                        k = lang[u] if segment else int(words.argmax())
                        mean = bits[a + u : a + v].mean(0)
                        share = 1 / np.exp2(np.clip(mean[k] - mean, -60, 60)).sum()
                        out.append((id_, code, segment, LANGUAGES[k], place[a + u], place[a + v - 1], int(n[a + u : a + v].sum()), int(v - u), float(min(1.0, share)), several, int(words[k]), bool(segment) and k in had))
                        if segment:
                            had.add(k)
                f = pd.DataFrame(out, columns=["doc_id", "code", "segment", "language", "first", "last", "words", "sentences", "confidence", "languages", "language_words", "again"])
                yield f.astype({"first": "Int64", "last": "Int64", "confidence": "float64"})

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", label_code(F.col("lang")).alias("code"), "text")
    return rows.mapInPandas(find, f"doc_id {kind}, code string, segment int, language string, first long, last long, words long, sentences long, confidence double, languages int, language_words long, again boolean")


def label_faults(found: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The first run in ``segments`` of each language with enough words in all its runs, of documents whose label is absent,
    names another language than their prose, or whose prose is in several languages. No exchange: a row of ``segments``
    says how many languages and words there are."""
    right = F.coalesce(F.col("code") == F.col("language"), F.lit(False))
    runs = found.where((F.col("segment") > 0) & ~F.col("again"))
    return runs.where((F.col("language_words") >= least_words) & ((F.col("languages") > 1) | ~right))
