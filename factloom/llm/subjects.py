"""Subject areas of documents: bisecting k-means over document vectors, leaves labelled by their discriminative terms.

Terms are Han bigrams, Latin words and pairs of Latin words, cut from whole texts with array operations per batch.
1. Vocabulary: a term is topical if it gathers in fewer documents than its frequency would spread it over (residual
   inverse document frequency), counted over the whole corpus.  Words of templates, names and site lines spread evenly.
2. Every document becomes a normalised vector of its topical terms; bisecting k-means clusters all of them.
3. A leaf's discriminative terms are compared with those of the documents that raters gave each subject; how alike they
   are gives the leaf's mixture of subjects.  No word list is part of the code: a subject is what its raters say.
4. A term's subject mixture is the mixture of its leaves; a sentence concerns the subject that its terms' mixtures
   favour, and counting terms over sentences so judged sharpens the mixtures (a few rounds over the whole corpus).
5. A document treats the subjects that at least SHARE of its subject sentences concern, else `general`.  A document's
   own label is not consulted for its row.

Only models of bounded size (vocabulary x subjects, vocabulary x leaves) pass through the driver.  Null and blank texts
have no row; texts are read whole; a table without labels leaves every document `general`, and so does a subject
without any label to its documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.form import to_form
from factloom.session import materialize

SHARE, GENERAL = 0.2, "general"
#: Leaves; most rounds of sharpening, and the share of all mentions that must change their subject for one more round.
#: Every topical term is in the model; MIN_DF bounds how many there can be.
LEAVES, ROUNDS, STABLE = 64, 5, 0.01
#: A term must stand in a share of documents between these (and in 3 at least) and gather this much more than chance.
MIN_DF, MAX_DF, MIN_GATHERING = 0.0008, 0.6, 1.35
#: How sharply a leaf's mixture follows the likeness of its discriminative terms to those of each subject.
SHARPNESS = 4
#: A term is discriminative where it stands this many times as often as in the whole corpus.
LIFT = 2.0
BREAK = -1
_WORD, _PAIR = 1 << 62, 1 << 62 | 1 << 61
_END = np.zeros(0x3010, dtype=bool)
for _c in "\n.!?。":
    _END[ord(_c)] = True
_LETTER = np.zeros(0x251, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0xC0:0x250] = _LETTER[0x5F] = True


@dataclass
class Terms:
    """Terms of a batch of texts: document, sentence (numbered through the batch), id, and where it starts."""

    doc: np.ndarray
    sentence: np.ndarray
    term: np.ndarray
    start: np.ndarray
    codes: np.ndarray


def cut(texts: list[str]) -> Terms:
    """All terms of all texts at once.  A Han bigram's id holds both characters; a word's id hashes its letters."""
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(codes):
        z = np.zeros(0, dtype=np.int64)
        return Terms(z, z, z, z, codes)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[: len(codes)]
    end = _END[np.minimum(codes, 0x300F)] | (codes == 0xFF01) | (codes == 0xFF1F)
    # a full stop between letters or digits ends nothing
    stop = np.flatnonzero(codes[:-1] == 0x2E)
    after = codes[stop + 1]
    end[stop] = (after == 0x20) | (after == 10) | (after >= 0x3000)
    sentence = np.cumsum(end) - end
    han = (codes >= 0x4E00) & (codes <= 0x9FFF)
    two = np.flatnonzero(han[:-1] & han[1:])
    bigram = codes[two] * 65536 + codes[two + 1]
    at_letter = np.flatnonzero(_LETTER[np.minimum(codes, 0x250)])  # a name like my_feed is one word
    words = pairs = at_pairs = first = np.zeros(0, dtype=np.int64)
    if len(at_letter):
        starts = np.flatnonzero(np.diff(at_letter, prepend=-2) != 1)
        length = np.diff(np.append(starts, len(at_letter)))
        first, last = at_letter[starts], at_letter[starts + length - 1]
        place = np.arange(len(at_letter)) - np.repeat(starts, length)
        lower = codes[at_letter]
        lower += ((lower >= 65) & (lower <= 90)) * 32
        value = (lower.astype(np.uint64) + np.uint64(7)) * _powers(int(length.max()))[place]
        words = (np.add.reduceat(value, starts) >> np.uint64(3)).astype(np.int64) | _WORD
        next_to = (first[1:] - last[:-1] == 2) & (codes[first[1:] - 1] == 0x20)
        at_pairs = first[:-1][next_to]
        pairs = ((words[:-1][next_to].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words[1:][next_to].astype(np.uint64)) >> np.uint64(3)).astype(np.int64) | _PAIR
    at = np.concatenate((two, first, at_pairs))
    term = np.concatenate((bigram, words, pairs))
    return Terms(doc[at], sentence[at], term, at, codes)


#: Characters cut at once: bounds the arrays of one step, whatever the batch.
STEP_CHARS = 400_000


def steps(texts: list[str]):
    """Consecutive slices (first, last) of the texts of at most STEP_CHARS characters, or one text."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and (size + len(t) > STEP_CHARS or i - first >= 16_000):
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def _powers(n: int) -> np.ndarray:
    """A weight of its own for every place of the longest word (powers of an odd number, modulo 2**64)."""
    return np.multiply.accumulate(np.full(n, 0x100000001B3, dtype=np.uint64))


def spell(codes: np.ndarray, start: int, term: int) -> str:
    """The word or two words that start here, whole."""
    size = 70
    while True:
        piece = "".join(map(chr, codes[start : start + size]))
        words = list(_LETTERS.finditer(piece, 0))[: 1 + (term >= _PAIR)]
        if words[-1].end() < len(piece) or start + size >= len(codes):
            return " ".join(m.group() for m in words).lower()
        size *= 4


_LETTERS = re.compile("[A-Za-zÀ-ɏ_]+")


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(term, documents, mentions) of several slices added up."""
    term = np.concatenate([p[0] for p in parts])
    order = np.argsort(term)
    term = term[order]
    new = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    return term[new], *(np.add.reduceat(np.concatenate([p[k] for p in parts])[order], new) for k in (1, 2))


def _counted(batch: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct term: documents, mentions and one place."""
    # 50 bits of a mixed term over 14 bits of the document within the slice: one sort does both
    low = (batch.doc & 0x3FFF).astype(np.uint64)
    key = (batch.term.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(0x3FFF) | low
    order = np.argsort(key)
    key = key[order]
    pair = np.concatenate(([True], key[1:] != key[:-1]))
    word = key >> np.uint64(14)
    new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    at = order[new]
    return batch.term[at], np.add.reduceat(pair.astype(np.int64), new), np.diff(np.append(new, len(key))), batch.start[at]


def vocabulary(texts: DataFrame) -> DataFrame:
    """Topical terms with document frequency and gathering; `slot` numbers them from 0."""

    def count(batches):
        parts: list[tuple[np.ndarray, ...]] = []
        names: dict[int, str] = {}
        bins = np.zeros((2, 64, 2), dtype=np.int64)  # alphabet, half-octave of length, (documents, units)
        for b in batches:
            values = [to_form(t) for t in b["text"]]
            for i, j in steps(values):
                terms = cut(values[i:j])
                for alphabet, in_it in enumerate((terms.term >= _WORD, terms.term < _WORD)):
                    n = np.bincount(terms.doc[in_it], minlength=j - i)
                    n = n[n > 0]
                    half = np.minimum(np.round(np.log2(n) * 2).astype(int), 63)
                    bins[alphabet, :, 0] += np.bincount(half, minlength=64)
                    bins[alphabet, :, 1] += np.bincount(half, weights=n, minlength=64).astype(np.int64)
                if not len(terms.term):
                    continue
                t, df, cf, at = _counted(terms)
                parts.append((t, df, cf))
                for k in np.flatnonzero(t >= _WORD):
                    if (x := int(t[k])) not in names:
                        names[x] = spell(terms.codes, at[k], x)
                if len(parts) >= 32:
                    parts = [_merged(parts)]
        a, h = np.nonzero(bins[:, :, 0])
        if len(a):
            yield pd.DataFrame({"term": -(a * 64 + h) - 1, "df": bins[a, h, 0], "cf": bins[a, h, 1], "example": [""] * len(a)})
        if parts:
            t, df, cf = _merged(parts)
            yield pd.DataFrame({"term": t, "df": df, "cf": cf, "example": [names[x] if x >= _WORD else chr(x >> 16) + chr(x & 0xFFFF) for x in t.tolist()]})

    counts = texts.mapInPandas(count, "term bigint, df bigint, cf bigint, example string").groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.min("example").alias("example"))
    counts = materialize(counts, "term-counts")
    # lengths of documents in each alphabet: a histogram of at most 2 x 64 bins
    rows = [(-r["term"] - 1 >= 64, r["df"], r["cf"]) for r in counts.where("term < 0").collect()]
    n_docs = {h: sum(r[1] for r in rows if r[0] == h) for h in (True, False)}
    total = {h: max(1, sum(r[2] for r in rows if r[0] == h)) for h in (True, False)}
    is_han = F.col("term") < _WORD

    def expected(h: bool):
        parts = [F.lit(float(docs)) * (1 - F.exp(-F.col("cf") * F.lit(units / docs / total[h]))) for a, docs, units in rows if a == h]
        return sum(parts, F.lit(0.0))

    gathering = F.when(is_han, expected(True)).otherwise(expected(False)) / F.col("df")
    least = max(3.0, MIN_DF * max(n_docs.values(), default=0))
    most = F.when(is_han, MAX_DF * n_docs[True]).otherwise(MAX_DF * n_docs[False])
    chosen = counts.where("term >= 0").where((F.col("df") >= least) & (F.col("df") <= most)).withColumn("gathering", gathering).where(F.col("gathering") >= MIN_GATHERING)
    return chosen


@dataclass
class Slots:
    """Topical terms sorted by id, and their slots."""

    term: np.ndarray
    names: list[str]

    def find(self, term: np.ndarray) -> np.ndarray:
        """Slot of each term, -1 for terms outside the vocabulary."""
        if not len(self.term) or not len(term):
            return np.full(len(term), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.term, term), len(self.term) - 1)
        return np.where(self.term[at] == term, at, -1)


def subject_sentences(texts: DataFrame, slots: Slots) -> DataFrame:
    """Per document, the slots of its topical terms sentence by sentence, with BREAK after each sentence that has any."""
    known = texts.sparkSession.sparkContext.broadcast(slots)  # the topical terms

    def find(batches):
        for b in batches:
            values = [to_form(t) for t in b.column("text").to_pylist()]
            flats, sizes = [], []
            for i, j in steps(values):
                terms = cut(values[i:j])
                slot = known.value.find(terms.term)
                hit = np.flatnonzero(slot >= 0)
                key = np.unique(terms.sentence[hit] * 2**31 + slot[hit])  # repeats within a sentence count once
                sentence, slot = key >> 31, (key & (2**31 - 1)).astype(np.int32)
                doc_of = np.zeros(int(terms.sentence.max(initial=0)) + 1, dtype=np.int64)
                doc_of[terms.sentence] = terms.doc
                ends = np.flatnonzero(np.append(sentence[1:] != sentence[:-1], True)) + 1 if len(sentence) else np.zeros(0, dtype=np.int64)
                flats.append(np.insert(slot, ends, BREAK))
                doc = np.insert(doc_of[sentence], ends, doc_of[sentence][ends - 1]) if len(ends) else np.zeros(0, dtype=np.int64)
                sizes.append(np.bincount(doc, minlength=j - i))
            if values:
                offsets = np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flats), pa.int32()))
                yield pa.record_batch([b.column("doc_id"), lists], names=["doc_id", "sentences"])

    return texts.select("doc_id", "text").mapInArrow(find, "doc_id bigint, sentences array<int>")


def vectors(sentences: DataFrame, n: int) -> DataFrame:
    """Normalised vectors of the documents with topical terms: term frequency times inverse document frequency."""
    from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer  # the driver's alone: the tasks never load it

    words = sentences.where(F.size("sentences") > 0).select("doc_id", F.filter("sentences", lambda x: x >= 0).cast("array<string>").alias("words"))
    counted = CountVectorizerModel.from_vocabulary([str(i) for i in range(n)], "words", "counts").transform(words)
    weighted = IDF(inputCol="counts", outputCol="weighted").fit(counted).transform(counted)
    return Normalizer(inputCol="weighted", outputCol="features").transform(weighted).select("doc_id", "features")


def leaves(points: DataFrame, k: int = LEAVES) -> DataFrame:
    """`doc_id` and `leaf` of every document by bisecting k-means with cosine distance.

    The vectors are written once; the clustering keeps what it reads of them in memory, or on disk.
    """
    from pyspark.ml.clustering import BisectingKMeans  # the driver's alone

    points = materialize(points, "vectors")
    model = BisectingKMeans(k=k, maxIter=8, seed=11, distanceMeasure="cosine", predictionCol="leaf").fit(points)
    return model.transform(points).select("doc_id", "leaf")


def rated(labels: DataFrame, names: list[str]) -> DataFrame:
    """Per labelled document, the numbers of its subjects; null, unknown and repeated labels fall away."""
    known = labels.where(F.col("subject").isin(names) & F.col("doc_id").isNotNull()).select("doc_id", "subject").distinct()
    number = F.array_position(F.array(*map(F.lit, names)), F.col("subject")).cast("int") - 1
    return known.groupBy("doc_id").agg(F.sort_array(F.collect_set(number)).alias("given"))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in a row, and the row of each; null lists have none."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(n)), n)


def _flat(sentences: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of a batch in a row, where each sentence starts, and the document of each sentence.

    With `keep`, slots it does not mark fall away, and sentences left without any.
    """
    all_, doc = _lists(sentences)
    number = np.cumsum(all_ == BREAK)
    use = all_ >= 0
    if keep is not None and len(keep):
        use &= keep[np.maximum(all_, 0)]
    slots, number, doc = all_[use], number[use], doc[use]
    starts = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(slots) else np.zeros(0, dtype=np.int64)
    return slots, starts, doc[starts]


def judge(slots: np.ndarray, starts: np.ndarray, doc: np.ndarray, n_docs: int, logs: np.ndarray, turns: int = 3) -> np.ndarray:
    """Probability of each subject for each sentence: its terms' mixtures and the other sentences of its document."""
    likelihood = np.add.reduceat(logs[slots], starts, axis=0)
    prior = theta = np.full((n_docs, logs.shape[1]), 1.0 / logs.shape[1])
    for _ in range(turns):
        p = likelihood + np.log(theta[doc])
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        total = np.stack([np.bincount(doc, weights=p[:, k], minlength=n_docs) for k in range(p.shape[1])], axis=1)
        theta = total * 0.9 + prior
        theta /= theta.sum(axis=1, keepdims=True)
    return p


def _sum(df: DataFrame, fn, shape: tuple[int, int]) -> np.ndarray:
    """Sum over partitions of matrices made by `fn` per batch; the shape bounds what reaches the driver."""

    def part(batches):
        total = np.zeros(shape)
        for b in batches:
            total += fn(b)
        i, j = np.nonzero(total)
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "x"])

    rows = df.mapInArrow(part, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    out = np.zeros(shape)
    out[rows.i, rows.j] = rows.x
    return out


def discriminative(counts: np.ndarray) -> np.ndarray:
    """Per column (a leaf or a subject), a unit vector of the terms that stand in it at least LIFT times as often as elsewhere."""
    share, whole = counts / np.maximum(counts.sum(axis=0), 1), counts.sum(axis=1, keepdims=True) / max(1, counts.sum())
    x = np.maximum(np.log(np.maximum(share / np.maximum(whole, 1e-12), 1e-9) / LIFT), 0) * np.log1p(counts)
    return x / np.maximum(np.linalg.norm(x, axis=0), 1e-9)


def label_leaves(by_leaf: np.ndarray, by_subject: np.ndarray) -> np.ndarray:
    """Mixture of subjects of each leaf (subjects x leaves), from how alike their discriminative terms are.

    A subject whose discriminative terms do not stand in a leaf LIFT times as often as in the corpus has no part in it.
    """
    telling = discriminative(by_subject)
    often = telling.T @ (by_leaf / np.maximum(by_leaf.sum(axis=0), 1))
    usual = telling.T @ (by_leaf.sum(axis=1) / max(1, by_leaf.sum()))
    like = np.where(often >= LIFT * np.maximum(usual, 1e-12)[:, None], telling.T @ discriminative(by_leaf), 0) ** SHARPNESS
    return like / np.maximum(like.sum(axis=0), 1e-9)


def mixtures(counts: np.ndarray) -> np.ndarray:
    """Log of each term's subject mixture, corrected for how common each subject is; evenly smoothed."""
    share = np.maximum(counts.sum(axis=0), 1e-9)
    share = share / share.sum()
    p = counts + 0.3 * share + 0.02
    p = p / p.sum(axis=1, keepdims=True) / np.maximum(share, 1e-4)
    return np.log(p / p.sum(axis=1, keepdims=True))


@dataclass
class Model:
    """Vocabulary, log mixtures, which terms are specific enough to make a sentence concern a subject, leaf labels."""

    slots: Slots
    names: list[str]
    logs: np.ndarray
    specific: np.ndarray
    leaf_terms: dict[int, list[str]]
    leaf_subjects: np.ndarray


def train(sentences: DataFrame, slots: Slots, labels: DataFrame, names: list[str]) -> Model:
    """Leaves, their labels, and the mixtures sharpened over all documents."""
    n, k = len(slots.term), len(names)
    if not n or not k:
        return Model(slots, names, np.zeros((n, max(1, k))), np.zeros(n, dtype=bool), {}, np.zeros((0, k)))
    placed = leaves(vectors(sentences, n))
    rows = materialize(sentences.where(F.size("sentences") > 0).join(rated(labels, names), "doc_id", "left").join(placed, "doc_id", "left"), "subject-rows")

    width = LEAVES + k

    def seen_in(b: pa.RecordBatch) -> np.ndarray:
        slot, starts, doc = _flat(b.column("sentences"))
        of = np.repeat(doc, np.diff(np.append(starts, len(slot))))
        leaf = b.column("leaf").to_numpy(zero_copy_only=False).astype(np.int64)
        out = np.bincount(slot * width + leaf[of], minlength=n * width).astype(float)
        subject, rated_doc = _lists(b.column("given"))
        share = 1 / np.maximum(np.bincount(rated_doc, minlength=len(leaf)), 1)
        number = np.full((len(leaf), k), False)
        number[rated_doc, subject] = True
        for j in np.unique(subject):
            mine = number[of, j]
            out += np.bincount(slot[mine] * width + LEAVES + j, weights=share[of[mine]], minlength=n * width)
        return out.reshape(n, width)

    seen = _sum(rows, seen_in, (n, width))
    by_leaf, by_subject = seen[:, :LEAVES], seen[:, LEAVES:]
    mixture = label_leaves(by_leaf, by_subject)
    telling = discriminative(by_leaf)
    leaf_terms = {leaf: [slots.names[i] for i in np.argsort(-telling[:, leaf])[:8]] for leaf in range(LEAVES) if by_leaf[:, leaf].any()}
    counts = by_leaf @ mixture.T
    for _ in range(ROUNDS):
        logs, before = mixtures(counts), counts

        def sharpen(b: pa.RecordBatch, logs=logs) -> np.ndarray:
            slot, starts, doc = _flat(b.column("sentences"))
            if not len(starts):
                return np.zeros((n, k))
            p = judge(slot, starts, doc, b.num_rows, logs)
            which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(slot))))
            return np.stack([np.bincount(slot, weights=p[which, j], minlength=n) for j in range(k)], axis=1)

        counts = _sum(rows, sharpen, (n, k))
        if np.abs(counts - before).sum() <= STABLE * counts.sum():
            break
    top = np.sort(counts, axis=1)[:, ::-1]
    specific = top[:, :2].sum(axis=1) / (counts.sum(axis=1) + 2.0) >= 0.8
    return Model(slots, names, mixtures(counts), specific, leaf_terms, mixture.T)


def assign(sentences: DataFrame, model: Model) -> DataFrame:
    """`doc_id`, `subject`, `n_sentences` (that concern it) and `n_subject_sentences`, for every document."""
    k = len(model.names)
    held = sentences.sparkSession.sparkContext.broadcast(model)

    def decide(batches):
        m = held.value
        names = pa.array([*m.names, GENERAL])
        for b in batches:
            slot, starts, doc = _flat(b.column("sentences"), m.specific)
            n = np.zeros((b.num_rows, max(1, k)), dtype=np.int64)
            if len(starts):
                best = judge(slot, starts, doc, b.num_rows, m.logs).argmax(axis=1)
                np.add.at(n, (doc, best), 1)
            total = n.sum(axis=1)
            i, j = np.nonzero(n * round(1 / SHARE) >= np.maximum(total, 1)[:, None])
            none = np.flatnonzero(total == 0)
            columns = [b.column("doc_id").take(pa.array(np.concatenate((i, none)))), names.take(pa.array(np.concatenate((j, np.full(len(none), k)))))]
            columns += [pa.array(np.concatenate((n[i, j], total[none]))), pa.array(np.concatenate((total[i], total[none])))]
            yield pa.record_batch(columns, names=["doc_id", "subject", "n_sentences", "n_subject_sentences"])

    return sentences.mapInArrow(decide, "doc_id bigint, subject string, n_sentences bigint, n_subject_sentences bigint")


def prepare(documents: DataFrame) -> tuple[DataFrame, Slots]:
    """Topical sentences of every document with a text, and the vocabulary behind them."""
    texts = documents.where(F.col("text").rlike(r"\S")).select("doc_id", "text")
    words = vocabulary(texts).orderBy("term").collect()  # the topical terms, each in MIN_DF of the documents
    slots = Slots(np.array([r["term"] for r in words], dtype=np.int64), [r["example"] for r in words])
    return materialize(subject_sentences(texts, slots), "subject-sentences"), slots


def classify(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> tuple[DataFrame, Model]:
    """Subjects of every document whose text is not blank, and the model."""
    names = sorted(r["subject"] for r in subjects.where("subject is not null").select("subject").distinct().collect() if r["subject"] != GENERAL)  # a fixed table
    sentences, slots = prepare(documents)
    model = train(sentences, slots, labels, names)
    return assign(sentences, model), model
