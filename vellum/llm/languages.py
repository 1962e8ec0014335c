"""Languages of documents and of their segments.

The model averages hashed subword embeddings of words and puts a linear softmax on the average.
It is trained by stochastic gradient descent in numpy on sentences of labelled documents, a
sample of at most PER_LANGUAGE documents of each language, the first by a hash of their ids; of
each at most TRAIN_CHARS characters are learnt from.
Labels may be wrong: a second training leaves out sentences that a first one, trained on other
documents, assigns to another language (unless it would leave out more than half of one). Every sentence is also trained without its accents. A
part that was held back fits the temperature of the probabilities and two confidences: under
`accept` a piece takes the language of its surroundings; under `reject` a guess is more often
wrong than right, and a segment is `unknown`.

A document is cut at line breaks and sentence ends; the best sequence of languages (Viterbi,
with a price for each change) joins these to segments. A language counts as present in a
document from `share` of its letters on.

Defined results: null and empty texts and documents with fewer than `least` letters have no
language and are no cases; a document most of whose letters are unknown is no case; repeated
rows are judged alike; an empty table gives no rows. Places count characters of the stored text.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANGS = ("vi", "en", "fr", "de", "es", "pt")
BUCKETS, DIM, EPOCHS, RATE, SEED = 1 << 15, 12, 3, 0.5, 5
STEPS, PER_LANGUAGE, TRAIN_CHARS = 400, 200, 20_000
SHARE, LEAST, CHANGE = 0.15, 20, 2.5
#: Names of the languages beside codes; compared without accents, case and punctuation.
NAMES = {
    "vi": "vi,vie,vn,vietnamese,vietnamien,vietnamesisch,vietnamita,tieng viet,viet,tiengviet",
    "en": "en,eng,english,anglais,englisch,ingles,inglese,tieng anh",
    "fr": "fr,fra,fre,french,francais,franzosisch,frances,tieng phap",
    "de": "de,deu,ger,german,allemand,deutsch,aleman,alemao,tieng duc",
    "es": "es,spa,spanish,espagnol,spanisch,espanol,espanhol,castellano,tieng tay ban nha",
    "pt": "pt,por,portuguese,portugais,portugiesisch,portugues,tieng bo dao nha",
}
#: Codes and names of other languages.
FOREIGN = "it ita italian italiano nl nld dut dutch ru rus russian zh zho chi chinese ja jpn japanese ko kor korean th tha thai la lat latin lo lao km khm khmer id ind indonesian ms msa malay tl tgl ar ara arabic hi hin hindi pl pol polish cs ces cze czech sv swe swedish da dan danish no nor nb nn norwegian fi fin finnish tr tur turkish el ell gre greek he heb hebrew hu hun hungarian ro ron rum romanian uk ukr ukrainian ca cat catalan gl glg galician bg bul bulgarian hr hrv sr srp sk slk sl slv et est lv lav lt lit fa fas per persian bn ben ta tam te tel ur urd my mya sw swa eu eus baq"
_WORD = re.compile(r"\b[^\W\d_]+\b")
_SPLIT = re.compile(r"[\r\n\f.!?…;:](?:(?<=[\r\n\f])[\r\n\f]*|[\"'”’»)\]*_]*\s+)")  # begins with one set, which is searched fast
_UNSEEN = re.compile("[­​-‏⁠-⁤︀-️﻿]")


def label(c: Column) -> Column:
    """One of LANGS, `other` for another language, or null where the label names none."""
    known = {n: k for k, names in NAMES.items() for n in names.split(",")} | dict.fromkeys(FOREIGN.split(), "other")
    c = F.translate(F.lower(F.trim(F.regexp_replace(c, r"[\s_\p{Z}\p{Cf}]+", " "))), "áàâãäçéèêëíìîïñóòôõöúùûüếệ", "aaaaaceeeeiiiinooooouuuuee")
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    code = F.regexp_extract(c, r"^([a-z]{2,3})(?:[- ][a-z]{4})?(?:[- ](?:[a-z]{2}|[0-9]{3}))?$", 1)  # with script and region
    return F.coalesce(F.try_element_at(table, c), F.try_element_at(table, code))


def clean(text: str) -> str:
    text = _UNSEEN.sub("", text)
    return text if text.isascii() else unicodedata.normalize("NFKC", text)


def words_of(text: str) -> list[str]:
    """The words of a text as they are scored."""
    return _WORD.findall(clean(text).lower())


def bare(word: str) -> str:
    """A word without accents."""
    return "".join([c for c in unicodedata.normalize("NFD", word.replace("đ", "d")) if not unicodedata.combining(c)])


def subwords(word: str) -> list[int]:
    w = f"<{word}>"
    got = [w, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))]
    return [zlib.crc32(g.encode()) % BUCKETS for g in got]


class Model:
    """Subword embeddings, the linear layer, the temperature and the confidence for acceptance."""

    def __init__(self, n: int = len(LANGS)):
        rng = np.random.default_rng(SEED)
        self.e = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.w = np.zeros((DIM, n), np.float32)
        self.b = np.zeros(n, np.float32)
        self.heat, self.accept, self.reject = 1.0, 0.5, 0.0
        self.known: dict[str, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def fit(self, x: list[list[str]], y: np.ndarray, rng: np.random.Generator, epochs: int = EPOCHS, batch: int = 128) -> Model:
        # a batch works on its distinct words: their subwords are summed once, and gradients go back by word
        code, uniq = pd.factorize(np.array([w for p in x for w in p], object))
        subs = [subwords(w) for w in uniq]
        many = np.array([len(i) for i in subs])
        flat, begin = np.array([i for w in subs for i in w], np.int64), np.r_[0, np.cumsum(many)]
        length = np.array([len(p) for p in x])
        first = np.r_[0, np.cumsum(length)]
        epochs = max(epochs, -(-STEPS * batch // max(1, len(x))))  # a small sample is read more often
        weight = 1 / np.maximum(np.bincount(y, minlength=len(self.b)), 1)
        weight = weight / weight[y].mean()
        for epoch in range(epochs):
            rate = RATE * (1 - epoch / epochs)
            order = rng.permutation(len(x))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                n = length[rows]
                at = np.r_[0, np.cumsum(n)[:-1]]
                words, of = np.unique(code[np.repeat(first[rows] - at, n) + np.arange(n.sum())], return_inverse=True)
                k = many[words]
                start = np.r_[0, np.cumsum(k)[:-1]]
                idx = flat[np.repeat(begin[words] - start, k) + np.arange(k.sum())]
                size = np.add.reduceat(k[of], at)
                h = np.add.reduceat(np.add.reduceat(self.e[idx], start, axis=0)[of], at, axis=0) / size[:, None]
                z = h @ self.w + self.b
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                g = (p * weight[y[rows]][:, None]).astype(np.float32)
                gh = (g @ self.w.T) / size[:, None]
                self.w -= rate * (h.T @ g) / len(rows) * 8
                self.b -= rate * g.mean(0)
                by = np.argsort(of, kind="stable")
                back = np.add.reduceat(np.repeat(gh, n, axis=0)[by], np.searchsorted(of[by], np.arange(len(words))), axis=0)
                by = np.argsort(idx)  # sums of equal rows; far cheaper than an unbuffered add
                at_, step = idx[by], np.repeat(back, k, axis=0)[by]
                edge = np.flatnonzero(np.r_[True, at_[1:] != at_[:-1]])
                self.e[at_[edge]] -= rate * np.add.reduceat(step, edge, axis=0)
        return self

    def vectors(self, words: list[str]) -> np.ndarray:
        """Of each word: its subwords' summed scores, and their number."""
        out = np.empty((len(words), len(self.b) + 1), np.float32)
        if len(self.known) > 500_000:
            self.known.clear()
        for k, w in enumerate(words):
            v = self.known.get(w)
            if v is None:
                i = subwords(w)
                v = self.known[w] = np.r_[self.e[i].sum(0) @ self.w, len(i)].astype(np.float32)
            out[k] = v
        return out

    def scores(self, pieces: list[list[str]]) -> np.ndarray:
        """Log-probabilities of the languages of each piece, flat for a piece without words."""
        size = np.array([len(p) for p in pieces])
        out = np.full((len(pieces), len(self.b)), -np.log(len(self.b)), np.float32)
        some = np.flatnonzero(size)
        if len(some):
            codes, uniq = pd.factorize(np.array([w for p in pieces for w in p], object))
            v = self.vectors(list(uniq))[codes]
            s = np.add.reduceat(v, np.r_[0, np.cumsum(size[some])[:-1]], axis=0)
            z = (s[:, :-1] / s[:, -1:] + self.b) / self.heat
            z -= z.max(1, keepdims=True)
            out[some] = z - np.log(np.exp(z).sum(1, keepdims=True))
        return out


def pieces_of(text: str) -> list[tuple[int, int]]:
    """Spans between line breaks and sentence ends."""
    out, a = [], 0
    for m in _SPLIT.finditer(text):
        out.append((a, m.end()))
        a = m.end()
    if a < len(text):
        out.append((a, len(text)))
    return out


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model from the labels of docs (doc_id, text, lang): the ids of the sample by one scan of the labels, then its texts."""
    draw = F.xxhash64(F.col("doc_id"), F.lit(17))
    first = F.row_number().over(Window.partitionBy("y").orderBy(draw, "doc_id"))  # at most per_language rows of a label leave a task
    ids = docs.select("doc_id", label(F.col("lang")).alias("y")).where(F.col("y").isin(*LANGS) & F.col("doc_id").isNotNull()).withColumn("n", first).where(F.col("n") <= per_language).select("doc_id", "y").distinct()
    rows = docs.select("doc_id", "text").where(F.length("text") >= LEAST).join(F.broadcast(ids), "doc_id")  # a bounded number of ids
    rows = rows.select("doc_id", "y", F.substring("text", 1, TRAIN_CHARS).alias("text")).toPandas().sort_values(["doc_id", "text"], kind="stable")
    x, y, doc = [], [], []
    for k, (t, lang) in enumerate(zip(rows["text"], rows["y"], strict=True)):
        t = clean(t)
        for a, b in pieces_of(t):
            w = _WORD.findall(t[a:b].lower())
            if len(w) >= 4:
                x.append(w)
                y.append(LANGS.index(lang))
                doc.append(k)
    return fit_clean(x, np.array(y, np.int64), np.array(doc, np.int64))


def fit_clean(x: list[list[str]], y: np.ndarray, doc: np.ndarray) -> Model:
    """Trains twice: on each half of the documents to find wrong labels in the other, then on what agrees."""
    rng = np.random.default_rng(SEED)
    model = Model()
    if not len(y):
        return model
    said = np.full(len(y), -1)
    for half in (0, 1):
        rows = np.flatnonzero(doc % 2 == half)
        rest = np.flatnonzero(doc % 2 != half)
        if len(rows) and len(rest):
            said[rest] = Model().fit([x[i] for i in rows], y[rows], rng, 2).scores([x[i] for i in rest]).argmax(1)
    agree = (said == y) | (said < 0)
    for k in range(len(LANGS)):
        if (y == k).any() and agree[y == k].mean() < 0.5:
            agree |= y == k
    fine = np.flatnonzero(agree)
    held = fine[doc[fine] % 10 == 9]
    used = fine[doc[fine] % 10 != 9]
    both = [x[i] for i in used] + [[bare(w) for w in x[i]] for i in used]
    model.fit(both, np.r_[y[used], y[used]], rng)
    if len(held) >= 50:
        tests = [x[i][:6] for i in held] + [[bare(w) for w in x[i][:6]] for i in held]
        truth = np.r_[y[held], y[held]]
        z = model.scores(tests)
        loss = {h: -np.mean(_soft(z / h)[np.arange(len(truth)), truth]) for h in (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)}
        model.heat = min(loss, key=loss.get)
        p = np.exp(_soft(z / model.heat))
        conf, right = p.max(1), p.argmax(1) == truth
        order = np.argsort(-conf)
        precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(precise >= 0.99)
        model.accept = float(min(0.9, max(0.4, conf[order][good[-1]]))) if len(good) else 0.9
        up = order[::-1]
        low = np.flatnonzero(np.cumsum(right[up]) <= 0.5 * np.arange(1, len(up) + 1))
        model.reject = min(model.accept, float(conf[up][low[-1]])) if len(low) else 0.0
    return model


def _soft(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def best_path(logp: np.ndarray, letters: np.ndarray, accept: float) -> np.ndarray:
    """The language of each piece: unsure pieces follow their surroundings. Without search only where the sure ones agree and the others are too few letters for a second language."""
    top = logp.argmax(1)
    sure = (np.exp(logp.max(1)) >= accept) & (letters > 0)
    if len(set(top[sure].tolist())) == 1 and letters[~sure].sum() < SHARE * letters.sum():
        return np.full(len(top), top[sure][0])
    emit = np.maximum(logp, -8.0) * np.minimum(1.0, letters / 20)[:, None]
    emit[~sure] *= 0.25
    cost = emit[0]
    back = np.zeros(emit.shape, np.int64)
    for i in range(1, len(emit)):
        stay, jump = cost, cost.max() - CHANGE
        back[i] = np.where(stay >= jump, np.arange(len(stay)), cost.argmax())
        cost = np.maximum(stay, jump) + emit[i]
    path = np.zeros(len(emit), np.int64)
    path[-1] = cost.argmax()
    for i in range(len(emit) - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


SEGMENT = "doc_id bigint, segment int, start int, length int, letters int, lang string, confidence double, guess string"


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    """Which code points are letters; beyond the table none is."""
    return np.fromiter((chr(i).isalpha() for i in range(0x33480)), bool, 0x33480)


def _pieces(text: str) -> tuple[list[tuple[int, int]], list[list[str]], np.ndarray]:
    """Spans of the stored text, the words of each as they are scored, and its letters."""
    spans = pieces_of(text)
    if text.isascii() or unicodedata.is_normalized("NFKC", text) and not _UNSEEN.search(text):
        words = [_WORD.findall(text[a:b].lower()) for a, b in spans]
    else:
        words = [_WORD.findall(clean(text[a:b]).lower()) for a, b in spans]
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    table = _alphabetic()
    count = np.r_[0, np.cumsum(table[np.minimum(code, len(table) - 1)])]
    at = np.array(spans)
    return spans, words, count[at[:, 1]] - count[at[:, 0]]


def judged(model: Model, texts: list[str], least: int = LEAST) -> Iterator[tuple[int, list[tuple[int, int, int, int, int, float]]]]:
    """Of each text with enough letters: its place in the list, and its segments (segment, start, length, letters, language, confidence)."""
    spans, words, letters, size = [], [], [], []
    for t in texts:
        s, w, n = _pieces(t) if t else ([], [], np.zeros(0, np.int64))
        spans += s
        words += w
        letters.append(n)
        size.append(len(s))
    if not spans:
        return
    n = np.concatenate(letters)
    logp = model.scores(words)
    edge = np.r_[0, np.cumsum(size)]
    some = np.flatnonzero(size)
    first = edge[some]
    top, best = logp.argmax(1), np.exp(logp.max(1))
    sure = (best >= model.accept) & (n > 0)
    total = np.add.reduceat(n, first)
    low, high = np.minimum.reduceat(np.where(sure, top, len(LANGS)), first), np.maximum.reduceat(np.where(sure, top, -1), first)
    plain = (low == high) & (np.add.reduceat(np.where(sure, 0, n), first) < SHARE * total)  # one language, without a search
    weight = np.maximum(n, 0.01)
    of = np.repeat(np.where(plain, high, 0), np.array(size)[some])
    mean = np.add.reduceat(np.exp(logp[np.arange(len(n)), of]) * weight, first) / np.add.reduceat(weight, first)
    for j, k in enumerate(some.tolist()):
        if total[j] < least:
            continue
        a, b = edge[k], edge[k + 1]
        if plain[j]:
            yield k, [(0, spans[a][0], spans[b - 1][1] - spans[a][0], int(total[j]), int(high[j]), float(mean[j]))]
            continue
        path = best_path(logp[a:b], n[a:b], model.accept)
        cut = np.flatnonzero(np.diff(path)) + 1
        out = []
        for s, (i, e) in enumerate(zip([0, *cut], [*cut, b - a])):
            w = weight[a + i : a + e]
            out.append((s, spans[a + i][0], spans[a + e - 1][1] - spans[a + i][0], int(n[a + i : a + e].sum()), int(path[i]), float((np.exp(logp[a + i : a + e, path[i]]) * w).sum() / w.sum())))
        yield k, out


def segments(docs: DataFrame, model: Model, least: int = LEAST) -> DataFrame:
    """The segments of every document with their language, or `unknown`, a confidence and the best guess. start and length count characters of the stored text, so a segment can be cut out of it."""
    from vellum.session import spread

    bc = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = bc.value
        for f in frames:
            ids = f["doc_id"].to_numpy(object)
            out = [(ids[k], *x[:4], LANGS[x[4]] if x[5] >= m.reject else "unknown", x[5], LANGS[x[4]]) for k, segs in judged(m, f["text"].tolist(), least) for x in segs]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SEGMENT.split(", ")])

    return spread(docs.select("doc_id", "text"), "doc_id").where(F.length("text") >= least).mapInPandas(run, SEGMENT)


def shares(segs: DataFrame) -> DataFrame:
    """(doc_id, lang, letters, share, confidence) of every language of a document."""
    g = segs.groupBy("doc_id", "lang").agg(F.sum("letters").alias("letters"), (F.sum(F.col("confidence") * F.col("letters")) / F.sum("letters")).alias("confidence"))
    t = segs.groupBy("doc_id").agg(F.sum("letters").alias("all"))
    return g.join(t, "doc_id").select("doc_id", "lang", "letters", (F.col("letters") / F.col("all")).alias("share"), "confidence")


def cases(docs: DataFrame, model: Model, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(doc_id, issue, lang): mixed for each language of a document in several, else missing or wrong with the true language; no row where the language is unknown."""
    s = segments(docs, model, least).groupBy("doc_id", "lang").agg(F.sum("letters").alias("letters"))
    s = s.groupBy("doc_id").agg(F.collect_list(F.struct("letters", "lang")).alias("l"), F.sum("letters").alias("all"))  # at most one entry per language
    s = s.withColumn("big", F.filter("l", lambda x: (x["letters"] >= share * F.col("all")) & (x["lang"] != "unknown"))).withColumn("first", F.array_max("l")["lang"])
    j = s.where("first <> 'unknown'").join(docs.select("doc_id", label(F.col("lang")).alias("named")), "doc_id")
    j = j.select("doc_id", F.when(F.size("big") > 1, "mixed").when(F.col("named").isNull(), "missing").when(F.col("named") != F.col("first"), "wrong").alias("issue"), F.when(F.size("big") > 1, F.col("big.lang")).otherwise(F.array("first")).alias("langs"))
    return j.where("issue is not null").select("doc_id", "issue", F.explode("langs").alias("lang")).distinct()
