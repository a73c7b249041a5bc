"""Language identification (operator 2).

One interpolated Kneser-Ney model of character 4-grams per language.  An order's n-grams are hashed
and kept in one sorted array with their discounted probabilities, the contexts in another with their
back-off weights; a lookup is a binary search.  The language of the lowest cross-entropy per
character wins; a document is rejected when even that lies above a limit calibrated on documents
that the models have not seen.

Every letter of the sample is a symbol of its own: a symbol has as many bits as that takes, up to ``MOST_BITS`` (beyond, rare letters share
symbols by their hash).

Learning: up to ``per_lang`` documents of each language, the ones with the smallest hash of their doc_id, of longer ones a window of ``SAMPLE_CHARS`` characters
at a place given by the hash; fewer and shorter ones where there are very many languages, so that the sample has ``SAMPLE_DOCS`` documents (one per
language at least) and ``TOTAL_CHARS`` characters at most, whatever the input, and the models at most 16 octets for each n-gram of it.  Of more than ``MOST_LANGS`` values of lang (ISO 639-3 has under 8,000) the
commonest are learnt.  These bounds fit the models, everything else reads whole texts of all documents.  A fifth of the sample only calibrates.

The score is the posterior of the language as if the text had at most ``EVIDENCE`` characters; the prediction weighs all of them.  Of languages with the same
cross-entropy the first by name wins.

Nulls, and texts without a letter: language ``und``, score 0, rejected.  Repeated rows get equal
results.  Texts of any length are scored whole.  Without a labelled document every language is
``und``.  An empty table gives an empty result.  ``identify`` keeps extra columns and replaces
columns with its own names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from octolith.llm.common import table

ORDER = 4
#: Bits of a symbol, at least and at most.  Symbols are 0: a letter that the sample lacks, 1: what stands between words, 2...: the sample's letters
SYMBOL_BITS, MOST_BITS = 6, 16
#: Looked-up values (n-grams times languages) that a worker keeps; beyond, it begins anew.
MEMO_VALUES = 1 << 23
PER_LANG, SAMPLE_CHARS, SAMPLE_DOCS, TOTAL_CHARS, MOST_LANGS = 400, 20_000, 200_000, 32_000_000, 10_000
CHUNK_CHARS, EVIDENCE = 500_000, 100
UNDECIDED = "und"
#: A document is rejected this many standard errors, plus this many nats, above what calibration saw.
REJECT_SIGMAS, REJECT_NATS = 6.0, 0.6


def held_out() -> Column:
    """Documents that are never learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, per_lang: int = PER_LANG) -> list[tuple[str, str]]:
    """(lang, text) of a bounded, repeatable sample of labelled documents that aren't held out."""
    length = F.char_length("text")
    rows = docs.select("doc_id", "lang", "text").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & (length > 0))
    hashed = rows.withColumn("_h", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 32)))
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    if not counts:
        return []
    per_lang = min(per_lang, max(1, SAMPLE_DOCS // len(counts)))
    window = min(SAMPLE_CHARS, TOTAL_CHARS // sum(min(per_lang, n) for n in counts.values()))
    begin = F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(length - window, F.lit(0)) + 1).cast("int") + 1
    # a threshold on the hash, on the scan itself: the window gets a few times per_lang rows of a language, however many there are
    most = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, 4.0 * per_lang * (1 << 32) / n)])
    near = hashed.filter(F.col("_h") <= F.try_element_at(most, F.col("lang")))
    w = Window.partitionBy("lang").orderBy("_h", "doc_id", F.xxhash64("text"))
    picked = near.select("lang", F.substring("text", begin, F.lit(window)).alias("text"), "_h", "doc_id").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= per_lang)
    return [(r.lang, r.text) for r in sorted(picked.collect(), key=lambda r: (r.lang, r._r))]


def _hash(code: np.ndarray) -> np.ndarray:
    """64-bit mix; a bijection, so packed n-grams keep apart."""
    x = code.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _packed(symbols: np.ndarray, order: int, bits: int = SYMBOL_BITS) -> np.ndarray:
    """The n-gram that ends at each position from ORDER-1 on, as one number."""
    n = len(symbols) - ORDER + 1
    code = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(order):
        code = (code << np.uint64(bits)) | symbols[ORDER - order + k :][: len(code)].astype(np.uint64)
    return code


def _last(codes: np.ndarray, order: int, bits: int) -> np.ndarray:
    """The last ``order`` symbols of packed n-grams."""
    return codes & np.uint64((1 << (bits * order)) - 1)


@dataclass
class _Lookup:
    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(codes: np.ndarray, values: np.ndarray) -> _Lookup:
        h = _hash(codes)
        order = np.argsort(h)
        return _Lookup(h[order], values[order].astype(np.float64))

    def get(self, codes: np.ndarray, missing: float) -> np.ndarray:
        h = _hash(codes)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], missing)


@dataclass
class KneserNey:
    """Interpolated, one discount per order; below the top order, counts are of distinct left neighbours."""

    grams: list[_Lookup]
    contexts: list[_Lookup]
    bits: int = SYMBOL_BITS

    @staticmethod
    def fit(streams: list[np.ndarray], bits: int = SYMBOL_BITS) -> KneserNey:
        top = np.concatenate([_packed(s, ORDER, bits) for s in streams])
        codes, counts = np.unique(top, return_counts=True)
        grams, contexts = [], []
        for order in range(ORDER, 0, -1):
            n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context = codes >> np.uint64(bits)
            ctx, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, weights=counts)
            kinds = np.bincount(where)
            grams.append(_Lookup.of(codes, np.maximum(counts - discount, 0) / total[where]))
            contexts.append(_Lookup.of(ctx, discount * kinds / total))
            codes, counts = np.unique(_last(codes, order - 1, bits), return_counts=True)
        return KneserNey(grams, contexts, bits)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        """ln P(last symbol | the ones before) of packed ORDER-grams."""
        codes = codes.astype(np.uint64)
        p = np.full(len(codes), 1 / (1 << self.bits))
        for k in range(ORDER - 1, -1, -1):  # from unigrams up
            order = ORDER - k
            code = _last(codes, order, self.bits)
            p = self.grams[k].get(code, 0.0) + self.contexts[k].get(code >> np.uint64(self.bits), 1.0) * p
        return np.log(p)


@dataclass
class LanguageModel:
    languages: list[str]
    symbol_of: np.ndarray  # by code point
    models: list[KneserNey]
    mean: np.ndarray  # nats per character, by language
    sigma: np.ndarray  # of one character's nats
    margin: np.ndarray  # calibrated
    bits: int = SYMBOL_BITS

    def streams(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all texts, each after ORDER-1 separators, runs of separators as one; where each begins."""
        pad = "\n" * (ORDER - 1)
        joined = pad + pad.join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        begin = np.r_[0, np.cumsum(np.fromiter((len(t) + ORDER - 1 for t in texts), dtype=np.int64, count=len(texts)))][:-1]
        symbols = self.symbol_of[points]
        keep = np.r_[True, (symbols[1:] != 1) | (symbols[:-1] != 1)]
        for k in range(ORDER - 1):
            keep[begin + k] = True
        return symbols[keep].astype(np.int64), np.cumsum(keep)[begin] - 1

    def _places(self, code: np.ndarray, memo: dict) -> np.ndarray:
        """The row in the memo's values of each n-gram; row 0 is 0."""
        if "values" not in memo or memo["values"].size > MEMO_VALUES:
            memo["values"] = np.zeros((1, len(self.models)))
            if self.bits == SYMBOL_BITS:
                memo["place"] = np.zeros(1 << (SYMBOL_BITS * ORDER), dtype=np.int32)
            else:  # too many n-grams for a table: sorted ones
                memo["keys"], memo["rows"] = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        if self.bits == SYMBOL_BITS:
            at = memo["place"][code]
            new = np.unique(code[at == 0])
        else:
            kinds, where = np.unique(code, return_inverse=True)
            to = np.searchsorted(memo["keys"], kinds)
            old = np.zeros(len(kinds), dtype=bool)
            if len(memo["keys"]):
                old = memo["keys"][np.minimum(to, len(memo["keys"]) - 1)] == kinds
            new = kinds[~old]
        if len(new):
            rows = np.arange(len(memo["values"]), len(memo["values"]) + len(new))
            memo["values"] = np.concatenate([memo["values"], np.stack([m.log_prob(new) for m in self.models], axis=1)])
            if self.bits == SYMBOL_BITS:
                memo["place"][new] = rows
            else:
                memo["keys"], memo["rows"] = np.insert(memo["keys"], to[~old], new), np.insert(memo["rows"], to[~old], rows)
        if self.bits == SYMBOL_BITS:
            return memo["place"][code]
        return memo["rows"][np.searchsorted(memo["keys"], kinds)][where]

    def score(self, texts: list[str], memo: dict) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropies (texts x languages; nats per character) and numbers of scored characters (0: no letter)."""
        symbols, begin = self.streams(texts)
        code = np.zeros(len(symbols), dtype=np.uint64)
        code[ORDER - 1 :] = _packed(symbols, ORDER, self.bits)
        at = self._places(code, memo)
        scored = np.ones(len(symbols), dtype=bool)
        for k in range(ORDER - 1):
            scored[begin + k] = False
        n = np.add.reduceat(scored, begin, dtype=np.int64)
        letters = np.add.reduceat(symbols != 1, begin, dtype=np.int64)
        at = np.where(scored, at, 0)  # row 0 of the values is 0
        entropy = np.stack([-np.add.reduceat(memo["values"][at, k], begin) / np.maximum(n, 1) for k in range(len(self.models))], axis=1)
        return entropy, np.where(letters > 0, n, 0)

    def decide(self, texts: list[str], memo: dict) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and whether it is rejected, of each text."""
        if not self.models:
            return [UNDECIDED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        entropy, n = self.score(texts, memo)
        best = entropy.argmin(axis=1)
        low = entropy.min(axis=1)
        weight = np.exp((low[:, None] - entropy) * np.minimum(n, EVIDENCE)[:, None])
        known = n > 0
        limit = self.mean[best] + self.margin[best] + REJECT_SIGMAS * self.sigma[best] / np.sqrt(np.maximum(n, 1))
        return [self.languages[k] if ok else UNDECIDED for k, ok in zip(best, known, strict=True)], np.where(known, 1 / weight.sum(axis=1), 0.0), np.where(known, low, 0.0), ~known | (low > limit)


def fit(sample: list[tuple[str, str]]) -> LanguageModel:
    languages = sorted({lang for lang, _ in sample})
    kinds, counts = np.unique(np.frombuffer("".join(t.lower() for _, t in sample).encode("utf-32-le"), dtype=np.uint32), return_counts=True)
    letters = sorted((-c, k) for k, c in zip(kinds.tolist(), counts.tolist(), strict=True) if chr(k).isalpha())
    bits = min(MOST_BITS, max(SYMBOL_BITS, (len(letters) + 1).bit_length()))
    own = {chr(k): s if s < 1 << bits else 2 + int(_hash(np.array([k]))[0]) % ((1 << bits) - 2) for s, (_, k) in enumerate(letters, start=2)}
    symbol_of = np.ones(0x110000, dtype=np.uint16)
    for k in range(0x110000):
        if (c := chr(k)).isalpha():
            symbol_of[k] = own.get(c.lower(), 0)
    out = LanguageModel(languages, symbol_of, [], *np.zeros((3, len(languages))), bits)
    checks = []
    for lang in languages:
        texts = [t for x, t in sample if x == lang]
        check = texts[::5] if len(texts) >= 5 else texts
        learn = [t for k, t in enumerate(texts) if k % 5] if len(texts) >= 5 else texts
        symbols, begin = out.streams(learn)
        out.models.append(KneserNey.fit(np.split(symbols, begin[1:]), bits))
        checks.append(check)
    for k, check in enumerate(checks):
        entropy, n = out.score(check, memo := {})
        own_entropy = entropy[n > 0, k] if (n > 0).any() else np.zeros(1)
        out.mean[k] = np.median(own_entropy)
        out.sigma[k] = memo["values"][1:, k].std() if len(memo["values"]) > 1 else 1.0
        over = own_entropy - out.mean[k] - REJECT_SIGMAS * out.sigma[k] / np.sqrt(np.maximum(n[n > 0], 1) if (n > 0).any() else 1.0)
        out.margin[k] = max(0.0, float(np.quantile(over, 0.99))) + REJECT_NATS
    return out


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Adds lang_pred, score, cross_entropy and rejected to every row of ``docs``."""
    # bounded by the sample's bound; the second part is a worker's own memory, kept between tasks
    shared = docs.sparkSession.sparkContext.broadcast((cloudpickle.dumps(model), {}))

    def run(texts: pa.Array) -> pa.Array:
        packed, memo = shared.value
        if "model" not in memo:
            memo["model"] = pickle.loads(packed)
        model = memo["model"]
        out: list[list] = [[], [], [], []]

        most = max(50_000, CHUNK_CHARS * 16 // max(16, len(model.models)))  # new n-grams of a chunk times languages stay few

        def chunks() -> Iterator[list[str]]:
            chunk, size = [], 0
            for t in texts:
                chunk.append(t := t.as_py() or "")
                size += len(t)
                if size >= most:
                    yield chunk
                    chunk, size = [], 0
            if chunk:
                yield chunk

        for chunk in chunks():
            for kept, new in zip(out, model.decide(chunk, memo), strict=True):
                kept.extend(new)
        kinds = [pa.string(), pa.float64(), pa.float64(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)], names=["lang_pred", "score", "cross_entropy", "rejected"])

    udf = F.arrow_udf(run, "lang_pred string, score double, cross_entropy double, rejected boolean")
    found = docs.withColumn("_lid", udf("text"))
    return found.withColumns({c: F.col(f"_lid.{c}") for c in ("lang_pred", "score", "cross_entropy", "rejected")}).drop("_lid")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled_sample(docs))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
