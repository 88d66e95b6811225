"""Missing or wrong document language labels.

A byte convolutional network (multi-width filters, max pooling, softmax) is trained in numpy on labelled texts and
applied to fixed-length windows of every sentence. Sentences give the languages of a block, blocks those of a document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Languages and what names them (two-letter code, three-letter codes, English name).
NAMES = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german"),
    "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"),
    "pt": ("pt", "por", "portuguese"),
    "it": ("it", "ita", "italian"),
    "nl": ("nl", "nld", "dut", "dutch"),
    "ru": ("ru", "rus", "russian"),
    "zh": ("zh", "zho", "chi", "chinese"),
}
LANGUAGES = tuple(NAMES)

#: Bounds of the training sample: texts per language, characters of a text; and the seed that picks them.
SAMPLE_PER_LANGUAGE, SAMPLE_CHARS, SEED = 250, 20_000, 17
#: Words and characters of a quoted title at most.
TITLE_WORDS, TITLE_CHARS = 12, 120
#: Window length in bytes; a sentence is covered by windows of which the last ends with it.
LENGTH = 96
DIM, FILTERS, WIDTHS = 8, 16, (2, 4, 6)
#: Training batches of the two judges and of the network.
STEPS = (150, 400)
#: A sentence is sure of its language from this probability on; others look to the languages with such a share of their text.
SURE, LIKELY = 0.95, 0.1
#: Letters below which a piece between full stops isn't taken for a sentence of its own.
FEW_LETTERS, FEW_IDEOGRAPHS = 18, 6

_BLOCK = re.compile(r"\r?\n[^\S\n]*(?:\r?\n[^\S\n]*)+")
#: Marks in pairs; a straight mark opens before a character and closes after one, so inches are none.
_QUOTED = re.compile(r"“([^”]*)”|„([^“”]*)[“”]|«([^»]*)»|《([^》]*)》|(?<![^\s(\[{—–/])\"(?=\S)([^\"]*)(?<=\S)\"(?!\w)")
_MARK = re.compile("[“„«《\"]")
_WHOLE = re.compile(r"[.!?。！？]\s*$|[.!?]\s+\S|[。！？]")
_STOP = re.compile(r"(?<=[.!?])[\s]+|(?<=[。！？])")
#: Ideographs stand next to codes and numbers without a blank and are no part of them.
_IDEOGRAPHS = "〇㐀-鿿豈-﫿\U00020000-\U0003ffff"
_CODE = re.compile(rf"(?<![^\W{_IDEOGRAPHS}])[^\W\d_{_IDEOGRAPHS}]*+\d(?:[^\W{_IDEOGRAPHS}]+|[,.\-]+)*+|[^\w\s'’]+|_+")


def label_language(c: Column) -> Column:
    """The language a label names, whatever its case, blanks, region or form; null if none."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"[-_][a-z0-9]*$", "")
    out = F.lit(None).cast("string")
    for lang, names in NAMES.items():
        out = F.when(bare.isin(*names), lang).otherwise(out)
    return out


def without_titles(block: str) -> str:
    """The block without quoted titles; longer quotations and whole sentences in quotation marks are text like any other, and
    so is a title where a block holds nothing else."""

    def cut(m: re.Match) -> str:
        inside = next((g for g in m.groups() if g is not None), "")
        return f" {inside} " if len(inside) > TITLE_CHARS or len(inside.split()) > TITLE_WORDS or _WHOLE.search(inside) else " "

    if not _MARK.search(block):
        return block
    bare, n = _QUOTED.subn(cut, block)
    return block if n and not any(c.isalpha() for c in bare) else bare


def sentences(block: str) -> list[str]:
    """The pieces of a block between full stops, quoted titles, codes and signs removed, lower case."""
    plain = lambda w: w if w.isalpha() else _CODE.sub("", w)
    return [" ".join(map(plain, s.split())).strip() for s in _STOP.split(without_titles(block).lower())]


def letters_in(s: str) -> int:
    return len(s) - s.count(" ")


def enough(s: str) -> bool:
    letters = letters_in(s)
    return letters >= FEW_LETTERS or (letters >= FEW_IDEOGRAPHS and any("一" <= c <= "鿿" for c in s))


def byte_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(windows x LENGTH bytes, number of its text): each text's bytes in windows, the last one moved back to end with it."""
    raw = [t.encode() for t in texts]
    size = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw) + bytes(LENGTH), np.uint8)
    start = np.cumsum(size) - size
    n = np.maximum(1, -(-size // LENGTH))
    of = np.repeat(np.arange(len(raw)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    offset = np.minimum(k * LENGTH, np.maximum(0, size[of] - LENGTH))
    x = flat[(start[of] + offset)[:, None] + np.arange(LENGTH)]
    return np.where(np.arange(LENGTH) < np.minimum(size[of], LENGTH)[:, None], x, 0).astype(np.uint8), of


class ByteNetwork:
    """Byte embedding, filters of several widths with ReLU and max pooling, softmax."""

    def __init__(self, classes: int, seed: int = SEED):
        rng = np.random.default_rng(seed)
        f32 = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {"e": f32(256, DIM, scale=0.5), "o": f32(FILTERS * len(WIDTHS), classes, scale=0.2), "ob": np.zeros(classes, np.float32)}
        for w in WIDTHS:
            self.p[f"w{w}"], self.p[f"b{w}"] = f32(w * DIM, FILTERS, scale=(w * DIM) ** -0.5), np.zeros(FILTERS, np.float32)
        self.tables: dict = {}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int, batch: int = 128, rate: float = 4e-3, seed: int = SEED) -> None:
        """Adam over ``steps`` batches, each with as many windows of every class, so that rare languages weigh as much."""
        rng, p = np.random.default_rng(seed), self.p
        of_class = [c for c in (np.flatnonzero(y == k) for k in range(len(p["ob"]))) if len(c)]
        each = -(-batch // max(1, len(of_class)))
        m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        for _ in range(steps if of_class else 0):
            at = np.concatenate([rng.choice(c, each) for c in of_class])
            xb, yb = x[at], y[at]
            emb = p["e"][xb]
            pooled, where = [], []
            for w in WIDTHS:
                patch = np.lib.stride_tricks.sliding_window_view(emb, w, axis=1).transpose(0, 1, 3, 2).reshape(len(xb), -1, w * DIM)
                a = patch @ p[f"w{w}"] + p[f"b{w}"]
                at = a.argmax(1)
                where.append(at)
                pooled.append(np.take_along_axis(a, at[:, None], 1)[:, 0])
            z = np.concatenate(pooled, 1)
            hid = np.maximum(z, 0)
            logit = hid @ p["o"] + p["ob"]
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(yb)), yb] -= 1
            d = prob / len(yb)
            g = {"o": hid.T @ d, "ob": d.sum(0), "e": np.zeros_like(p["e"])}
            dz = (d @ p["o"].T) * (z > 0)
            for i, w in enumerate(WIDTHS):
                dw = dz[:, i * FILTERS : (i + 1) * FILTERS]
                bytes_at = xb[np.arange(len(xb))[:, None, None], where[i][:, :, None] + np.arange(w)]
                patch = p["e"][bytes_at]
                g[f"w{w}"] = np.einsum("bf,bfjd->jdf", dw, patch).reshape(w * DIM, FILTERS)
                g[f"b{w}"] = dw.sum(0)
                np.add.at(g["e"], bytes_at, dw[:, :, None, None] * p[f"w{w}"].reshape(w, DIM, FILTERS).transpose(2, 0, 1)[None])
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
        self.tables = {}

    def _tables(self) -> dict:
        """For each pair of bytes what it adds to the filters at each even place of a width."""
        if not self.tables:
            for w in WIDTHS:
                one = np.einsum("cd,jdf->jcf", self.p["e"], self.p[f"w{w}"].reshape(w, DIM, FILTERS))
                self.tables[w] = [(one[j][:, None] + one[j + 1][None]).reshape(1 << 16, FILTERS) for j in range(0, w, 2)]
        return self.tables

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        out = []
        for lo in range(0, len(x), 512):
            xb = x[lo : lo + 512].astype(np.intp)
            pair = (xb[:, :-1] << 8) | xb[:, 1:]
            pooled = []
            for w, tables in self._tables().items():
                n = LENGTH - w + 1
                a = tables[0].take(pair[:, :n], axis=0)
                for k, t in enumerate(tables[1:], 1):
                    a += t.take(pair[:, 2 * k : 2 * k + n], axis=0)
                pooled.append(a.max(1) + self.p[f"b{w}"])
            logit = np.maximum(np.concatenate(pooled, 1), 0) @ self.p["o"] + self.p["ob"]
            logit -= logit.max(1, keepdims=True)
            out.append(logit - np.log(np.exp(logit).sum(1, keepdims=True)))
        return np.concatenate(out) if out else np.zeros((0, len(LANGUAGES)))

    def sentences(self, texts: list[str]) -> np.ndarray:
        """Probabilities of each sentence's languages: the mean over its windows of their log probabilities."""
        if not texts:
            return np.zeros((0, len(LANGUAGES)))
        x, of = byte_windows(texts)
        lp = self.log_probabilities(x)
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        mean = np.add.reduceat(lp, first) / np.diff(np.append(first, len(of)))[:, None]
        prob = np.exp(mean - mean.max(1, keepdims=True))
        return prob / prob.sum(1, keepdims=True)


def training_sample(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(language, text) of about ``per_language`` documents at most whose label names each language, picked by a hash of their text; no more than twice as many in all.

    The sample alone is bounded, in texts and in ``chars`` of a text; the network is applied to whole texts.
    """
    named = documents.select(label_language(F.col("lang")).alias("l"), "text").where("l is not null and text is not null")
    counts = dict(named.groupBy("l").agg(F.count("*").alias("n")).collect())  # nine at most
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("l") == lang, min(1.0, per_language / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit(SEED), "text"), F.lit(1_000_000))
    picked = named.withColumn("draw", draw).where(F.col("draw") < share * 1_000_000).select("l", F.left("text", F.lit(chars)).alias("text"), "draw")
    return [(r[0], r[1]) for r in picked.orderBy("draw", "l", "text").limit(2 * per_language * len(LANGUAGES)).collect()]


def train(sample: list[tuple[str, str]], per_text: int = 12) -> ByteNetwork:
    """A network trained on the sample's sentences.

    Labels are wrong at times and texts mixed, so two networks are first trained on half of the texts each and judge
    the sentences of the other half: those surely in another language than their text's label get that language, those
    merely doubted are left out of the last training.
    """
    rng = np.random.default_rng(SEED)
    said: list[str] = []
    label: list[int] = []
    half: list[int] = []
    for n, (lang, text) in enumerate(sorted(sample)):
        own = [s for b in _BLOCK.split(text) for s in sentences(b) if enough(s)]
        for i in rng.permutation(len(own))[:per_text]:
            said.append(own[i])
            label.append(LANGUAGES.index(lang))
            half.append(n % 2)
    net = ByteNetwork(len(LANGUAGES))
    if not said:
        return net
    y, part, keep = np.array(label, np.int64), np.array(half), np.ones(len(said), bool)
    x, of = byte_windows(said)
    judged = y.copy()
    for k in (0, 1):
        judge = ByteNetwork(len(LANGUAGES))
        judge.fit(x[part[of] == k], y[of[part[of] == k]], STEPS[0])
        other = np.flatnonzero(part != k)
        prob = judge.sentences([said[i] for i in other])
        best, sure = prob.argmax(1), prob.max(1) > SURE
        keep[other] = (best == y[other]) | sure
        judged[other] = np.where(sure, best, y[other])
    net.fit(x[keep[of]], judged[of[keep[of]]], STEPS[1])
    return net


def segment_languages(net: ByteNetwork, texts: list[str]) -> list[list[tuple[int, str, float]]]:
    """For each text the (seg_no, language, confidence) of its segments: one with number 0 if it has one language."""
    said, place = [], []
    for i, t in enumerate(texts):
        for k, block in enumerate(_BLOCK.split(t.strip()), 1):
            for s in sentences(block):
                if s:
                    said.append(s)
                    place.append((i, k, enough(s), letters_in(s)))
    prob = net.sentences(said)
    votes: list[dict] = [{} for _ in texts]
    loose: list[list] = [[] for _ in texts]
    if not said:
        return [[] for _ in texts]
    doc, _, whole, letters = (np.array(c) for c in zip(*place, strict=True))
    weight = np.zeros((len(texts), len(LANGUAGES)))  # letters by language, of the sentences of each text
    np.add.at(weight, doc[whole], letters[whole, None] * prob[whole])
    likely = (weight > LIKELY * weight.sum(1, keepdims=True))[doc]
    best = prob.argmax(1)
    unsure = (prob.max(1) < SURE) & likely.any(1)  # an unsure sentence has one of its text's languages
    best = np.where(unsure, np.where(likely, prob, -1).argmax(1), best)
    of_best = prob[np.arange(len(best)), best]
    for n, ((i, k, full, size), j, p) in enumerate(zip(place, best.tolist(), of_best.tolist(), strict=True)):
        if full:
            m, s = votes[i].get((k, j), (0, 0.0))
            votes[i][k, j] = (m + size, s + size * p)
        else:
            loose[i].append((size, prob[n]))
    out = []
    for v, rest in zip(votes, loose, strict=True):
        if not v and rest:  # nothing but short pieces: together they count
            p = np.average([p for _, p in rest], axis=0, weights=[n for n, _ in rest])
            v = {(1, int(p.argmax())): (1, float(p.max()))}
        langs = {j for _, j in v}
        if len(langs) == 1:
            n, s = (sum(c) for c in zip(*v.values(), strict=True))
            out.append([(0, LANGUAGES[langs.pop()], s / n)])
        else:
            out.append([(k, LANGUAGES[j], s / n) for (k, j), (n, s) in sorted(v.items())])
    return out


def identify(documents: DataFrame, net: ByteNetwork) -> DataFrame:
    """(doc_id, label, seg_no, lang, confidence): every document with letters, and each block and language of a mixed one.

    ``label`` is the language that the document's own label names, or null. Null and blank texts and texts without letters give nothing.
    """
    held = documents.sparkSession.sparkContext.broadcast(net.p)  # some 15 kB

    def run(batches):
        net = ByteNetwork(len(LANGUAGES))
        net.p = held.value
        for batch in batches:
            texts, ids, labels = (batch.column(c).to_pylist() for c in ("text", "doc_id", "label"))
            for lo in range(0, len(texts), 200):
                rows = [(ids[lo + i], labels[lo + i], *seg) for i, segs in enumerate(segment_languages(net, texts[lo : lo + 200])) for seg in segs]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64()), strict=True)], ["doc_id", "label", "seg_no", "lang", "confidence"])

    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", label_language(F.col("lang")).alias("label"))
    return docs.mapInArrow(run, "doc_id bigint, label string, seg_no bigint, lang string, confidence double")


def wrong_labels(documents: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, net: ByteNetwork | None = None) -> DataFrame:
    """(doc_id, seg_no, lang, confidence) of documents whose label doesn't name their language, and of all that mix languages.

    ``net`` is a fitted network; without one, one is trained on a sample of these documents.
    """
    found = identify(documents, net or train(training_sample(documents, per_language)))
    return found.where("seg_no > 0 or label is null or label <> lang").drop("label").distinct()
