"""Language identification with error-correcting output codes.

Every language has a codeword of ``BITS`` bits, chosen from a seed so that codewords lie far apart. Each bit is predicted by a
binary n-gram classifier: naive-Bayes log odds of the hashed byte 2-, 3- and 4-grams of the lower-cased letters, learned from the
languages whose codeword has the bit against those that have not. A document's margin for a bit is the mean over its n-grams;
decoding weighs each bit's logistic loss by how well the bit did on training windows, and takes the nearest codeword. The score
is the posterior of that codeword under the weighted losses; ``ambiguous`` marks documents whose runner-up comes close.

Whether a text's language can be told (``keep_identified``) is settled between the best language and the runner-up alone, so the rule means
the same at any number of languages. The lead is the mean margin an n-gram has for the best over the bits in which the two codewords differ;
it is near 0 for unknown languages and for even mixtures, and at a level that the labelled training windows show for clean texts. A text goes
if the two languages' own posteriors are within TIE of even, or if its lead is below ``LEAST_LEAD`` of the clean level. Short texts have
noisy leads: where clean windows scatter below that share, the bound sinks by their scatter, which falls with the root of the length.

The fit uses a bounded sample: at most ``SAMPLE_CELLS`` texts a language, one for each cell of a hash of doc_id, and the ``MAX_LANGUAGES``
languages with most rows. One in ``CALIBRATE_EVERY`` of a language's texts (by the hash) isn't counted: windows of these held-back texts
settle the bits' weights and scales and what a clean lead is; a language with fewer texts lends them for both. Everything is picked by hashes and
summed in whole numbers, and a text's margins come from its own n-grams alone, so results don't depend on the order or the partitions of
the rows. Only thin columns are shuffled to choose the sample; its texts are counted by the executors, and the driver gets one row of
``BUCKETS`` counts and at most SAMPLE_CELLS / CALIBRATE_EVERY x WINDOWS windows for each language. Prediction is one pass without a
shuffle over whole texts, with a model of BUCKETS x BITS floats.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled row everything is ``und``;
with a single language every text with a letter has it with score 1 and stays. Repeated rows give repeated rows, an empty table an empty
result; ties go to the language that is first in order; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.batches import bounded_batches
from colonnade.session import shared_checkpoints

BUCKETS = 1 << 14
BITS = 31
SAMPLE_CELLS = 512
FIT_TASKS = 32
MAX_LANGUAGES = 512
CALIBRATE_EVERY = 6
WINDOWS = 8
MAX_CALIBRATION = 4096
UNKNOWN = "und"
SMOOTHING = 0.2
AMBIGUOUS = 0.75
TIE = 0.05
LEAST_LEAD = 0.25
SCATTER = 2.0
WINDOW = 60

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, runner_up string, ambiguous boolean"
LETTERS = re.compile(r"[^\W\d_]+")
# ASCII letters and all bytes of multi-byte characters stay, everything else is a word break.
KEPT = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], "u4")


def has_letter(text: str) -> bool:
    return any(m.group()[0].isalpha() or any(map(str.isalpha, m.group())) for m in LETTERS.finditer(text))


def buckets_of(text: str) -> np.ndarray:
    """Hashed n-grams of the whole text (runs of breaks count as one), as bucket numbers."""
    a = KEPT[np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), "u1")]
    a = a[np.concatenate(([True], (a[1:] != 32) | (a[:-1] != 32)))]
    two = a[:-1] * np.uint32(0x9E3779B1) + a[1:] * np.uint32(0x85EBCA6B)
    three = two[:-1] * np.uint32(0xC2B2AE35) + a[2:] * np.uint32(0x27D4EB2F)
    four = three[:-1] * np.uint32(0x165667B1) + a[3:] * np.uint32(0x9E3779B1)
    h = np.concatenate((two, three, four))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(18)).astype("i8")


def margins_of(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean log odds of each text's n-grams for each bit, and how many n-grams it has; text by text, so neighbours make no difference."""
    margins, total = np.zeros((len(texts), weights.shape[1])), np.zeros(len(texts))
    for i, t in enumerate(texts):
        counts = np.bincount(buckets_of(t), minlength=len(weights))
        found = np.flatnonzero(counts)
        total[i] = max(1, counts.sum())
        margins[i] = counts[found].astype("f8") @ weights[found] / total[i]
    return margins, total


def codewords(n: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """n codewords, greedily chosen among random ones to be far apart; no bit is the same for all."""
    if n < 2:
        return np.zeros((n, bits), bool)
    rng = np.random.default_rng(seed)
    words = rng.random((1, bits)) < 0.5
    while len(words) < n:
        pool = rng.random((256, bits)) < 0.5
        words = np.vstack((words, pool[(pool[:, None] != words[None]).sum(2).min(1).argmax()]))
    for b in np.flatnonzero(words.all(0) | ~words.any(0)):  # then the bit asks for one language alone
        words[:, b] = False
        words[b % n, b] = True
    return words


@dataclass
class Model:
    languages: list[str]
    words: np.ndarray  # language, bit
    weights: np.ndarray  # bucket, bit: log odds
    trust: np.ndarray  # bit
    scale: np.ndarray  # bit
    clean: float = 0.0  # lead of labelled windows
    slack: float = 0.0  # how far all but 1 % of them lie below it, times the root of their n-grams

    def decode(self, margins: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Best and second language, the posterior of the best, its share of the two's posterior and its lead for each row of margins."""
        # longer texts have surer margins, so the loss is taken at a steepness that grows with the root of the length
        steep = np.sqrt(np.minimum(total, 4096.0))[:, None] * margins / self.scale
        signs = np.where(self.words, 1.0, -1.0)
        loss = (np.logaddexp(0, -steep[:, None, :] * signs[None]) * self.trust).sum(2) / self.trust.sum() * 4
        order = np.argsort(loss, axis=1, kind="stable")
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        rows = np.arange(len(loss))
        best, second = order[:, 0], order[:, min(1, loss.shape[1] - 1)]
        apart = (signs[best] - signs[second]) / 2 * self.trust
        lead = (margins / self.scale * apart).sum(1) / np.maximum(np.abs(apart).sum(1), 1e-9)
        return best, second, p[rows, best], p[rows, best] / (p[rows, best] + p[rows, second]), lead

    def told(self, share: np.ndarray, lead: np.ndarray, n: np.ndarray, least: float = LEAST_LEAD) -> np.ndarray:
        """Whether the best language stands clear of the runner-up in texts of n n-grams."""
        if len(self.languages) < 2:
            return np.ones(len(lead), bool)
        bound = np.minimum(least * self.clean, self.clean - SCATTER * self.slack / np.sqrt(np.maximum(n, 1)))
        return (share >= 0.5 + TIE) & ((lead >= bound) | (n < 3 * WINDOW))  # shorter texts than the windows have no known scatter


def held_out(doc_id=None):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame) -> Model:
    """Learns from rows (doc_id, text, lang) that are not held out."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared_checkpoints(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    able = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).withColumn("h", F.xxhash64("text"))
    draw = F.xxhash64("doc_id")
    cells = able.groupBy("lang", F.pmod(draw, F.lit(SAMPLE_CELLS)).alias("cell")).agg(F.min(F.struct(draw.alias("draw"), "doc_id", "h")).alias("pick"), F.count("*").alias("n")).checkpoint()
    languages = sorted(r["lang"] for r in cells.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES).collect())
    if not languages:
        return Model([], np.zeros((0, BITS), bool), np.zeros((BUCKETS, BITS)), np.ones(BITS), np.ones(BITS))
    kept = spark.createDataFrame([(x,) for x in languages], "lang string")
    by_language: dict[str, list[tuple]] = {}
    for r in sorted(cells.join(F.broadcast(kept), "lang").select("lang", "pick.draw", "pick.doc_id", "pick.h").collect()):  # at most SAMPLE_CELLS x MAX_LANGUAGES
        by_language.setdefault(r["lang"], []).append((r["doc_id"], r["lang"], r["h"]))
    picks = []
    for found in by_language.values():
        for k, pick in enumerate(found):
            calibrates = len(found) < CALIBRATE_EVERY or k % CALIBRATE_EVERY == 0
            picks.append((*pick, len(found) < CALIBRATE_EVERY or not calibrates, calibrates))
    picked = F.broadcast(spark.createDataFrame(picks, "doc_id long, lang string, h long, counted boolean, calibrates boolean"))
    sample = able.join(picked, ["doc_id", "lang", "h"]).dropDuplicates(["doc_id", "lang", "h"]).select("lang", "text", "counted", "calibrates")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        windows: dict[str, list[str]] = {}
        for b in batches:
            for lang, text, counted, calibrates in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, "i8"))
                held = windows.setdefault(lang, [])
                if counted:
                    sums[lang] += np.bincount(buckets_of(text), minlength=BUCKETS)
                if calibrates and len(text) > 8:
                    held += [text[i : i + WINDOW] for i in range(0, len(text), max(WINDOW, -(-len(text) // WINDOWS)))]
        names = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([sums[k].tobytes() for k in names], pa.binary()), pa.array([windows[k] for k in names], pa.list_(pa.string()))], ["lang", "counts", "windows"])

    def total(table):
        counts = sum(np.frombuffer(c, "i8") for c in table["counts"].to_pylist())
        windows = sorted(w for ws in table["windows"].to_pylist() for w in ws)
        return pa.table({"lang": table["lang"][:1], "counts": pa.array([counts.tobytes()], pa.binary()), "windows": pa.array([windows], pa.list_(pa.string()))})

    dealt = sample.repartition(FIT_TASKS, F.col("lang"), F.pmod(F.xxhash64("text"), F.lit(4)))
    got = dealt.mapInArrow(count, "lang string, counts binary, windows array<string>").groupBy("lang").applyInArrow(total, "lang string, counts binary, windows array<string>").collect()
    index = {k: i for i, k in enumerate(languages)}
    table = np.zeros((len(languages), BUCKETS))
    windows: list[tuple[int, str]] = []
    for r in got:
        table[index[r["lang"]]] += np.frombuffer(r["counts"], "i8")
        windows += [(index[r["lang"]], w) for w in r["windows"]]
    return fit_counts(languages, table, sorted(windows)[:: max(1, len(windows) // MAX_CALIBRATION)])


def fit_counts(languages: list[str], table: np.ndarray, windows: list[tuple[int, str]]) -> Model:
    words = codewords(len(languages))
    share = (table + SMOOTHING) / (table + SMOOTHING).sum(1, keepdims=True)
    weights = np.zeros((BUCKETS, BITS))
    for b in range(BITS):
        one = words[:, b]
        if one.any() and not one.all():
            weights[:, b] = np.log(share[one].mean(0)) - np.log(share[~one].mean(0))
    weights -= (share.mean(0) @ weights)[None]  # the mean text is undecided
    model = Model(languages, words, weights, np.ones(BITS), np.ones(BITS))
    if len(languages) > 1 and windows:
        margins, n = margins_of([w for _, w in windows], weights)
        truth = words[[i for i, _ in windows]]
        right = ((margins > 0) == truth).mean(0)
        model.trust = np.maximum(0.05, 2 * right - 1)
        model.scale = np.maximum(1e-3, np.abs(margins).mean(0) * 4)
        best, _, _, _, lead = model.decode(margins, n)
        good = best == [i for i, _ in windows]
        if good.any():
            model.clean = float(np.median(lead[good]))
            model.slack = max(0.0, float(np.quantile((model.clean - lead[good]) * np.sqrt(n[good]), 0.99)))
    return model


def judge(model: Model, texts: pa.Array, least: float = LEAST_LEAD) -> tuple[list, np.ndarray, list, np.ndarray]:
    """Languages, scores and runners-up of a column of texts, and whether the language can be told."""
    lang, second, score, told = [UNKNOWN] * len(texts), [None] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    found = [(i, t) for i, x in enumerate(texts) if model.languages and (t := x.as_py()) and has_letter(t)]
    if found:
        margins, n = margins_of([t for _, t in found], model.weights)
        best, other, p, share, lead = model.decode(margins, n)
        sure = model.told(share, lead, n, least)
        for (i, _), k, m, s, ok in zip(found, best.tolist(), other.tolist(), p.tolist(), sure.tolist(), strict=True):
            lang[i], score[i], told[i] = model.languages[k], s, ok
            second[i] = model.languages[m] if m != k else None
    return lang, score, second, told


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document (SCHEMA): language, score and whether the runner-up comes close."""
    bounded_batches(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("runner_up", pa.string()), ("ambiguous", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, second, _ = judge(model, b.column(2))
            unsure = pa.array([k == UNKNOWN or bool(s < AMBIGUOUS) for k, s in zip(lang, score, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(second, pa.string()), unsure], schema=out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the labelled rows that are not held out and predicts all rows."""
    return predict(docs, fit(docs))


def keep_identified(docs: DataFrame, least: float = LEAST_LEAD) -> DataFrame:
    """The rows of docs whose language can be told: not ``und``, and clear of the runner-up (``Model.told``). A null lang is filled in; nothing else changes."""
    model, names = fit(docs), docs.columns
    at, lang_at = names.index("text"), names.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, _, _, keep = judge(model, b.column(at), least)
            cols = list(b.columns)
            cols[lang_at] = pa.array([k if v is None else v for k, v in zip(best, cols[lang_at].to_pylist(), strict=True)], b.schema.field(lang_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
