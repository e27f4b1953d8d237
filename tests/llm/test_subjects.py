import random

import numpy as np
from pyspark.sql import functions as F

from factloom.llm import subjects as sb
from factloom.session import table

WORDS = {"software": ["数据库", "代码仓", "云平台", "开源库", "接口层"], "transport": ["铁路线", "港口群", "集装箱", "快递网", "航线图"], "liquor": ["酱香型", "浓香型", "窖池群", "年份酒", "经销商"]}


def corpus(n=240, seed=1):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        subjects = r.sample(sorted(WORDS), r.choice([1, 1, 2])) if i % 12 else []
        lines = ["会议纪要如下，以下为摘要。", f"本周收到{i}条反馈，整体平稳。"]
        for s in subjects:
            for _ in range(8):
                a, b = r.sample(WORDS[s], 2)
                lines.append(f"从{a}看，{b}仍是分歧所在。")
        r.shuffle(lines)
        docs.append((i, "\n".join(lines), "x"))
        truth[i] = set(subjects) or {"general"}
    docs += [(n, None, "x"), (n + 1, "  \n ", "x"), (n + 2, "短", "x")]
    truth[n + 2] = {"general"}
    return docs, truth


def frames(spark, docs, truth, rate=4):
    labels = [(i, s, "r1") for i, t in truth.items() if i % rate == 0 for s in t] + [(1, None, "r2"), (None, "liquor", "r2"), (2, "unknown", "r1")]
    return (
        spark.createDataFrame(docs, "doc_id bigint, text string, sentences string"), spark.createDataFrame(labels, "doc_id bigint, subject string, rater string"),
        spark.createDataFrame([(s, "") for s in [*WORDS, "general", None]], "subject string, name_zh string"),
    )


def test_accuracy_on_documents_without_labels(spark):
    docs, truth = corpus()
    out, model = sb.classify(*frames(spark, docs, truth))
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert set(got) == set(truth)  # every text that is not blank, and no other
    held_out = [i for i in truth if i % 4]
    assert sum(got[i] == truth[i] for i in held_out) / len(held_out) >= 0.95
    assert model.leaf_terms


def names_of(out):
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    return got


def test_one_leaf_tells_nothing(spark, monkeypatch):
    docs, truth = corpus()
    monkeypatch.setattr(sb, "leaves", lambda points, k=sb.LEAVES: points.select("doc_id", F.lit(0).alias("leaf")))
    got = names_of(sb.classify(*frames(spark, docs, truth))[0])
    assert sum(got[i] == truth[i] for i in truth) / len(truth) < 0.5


def test_held_out_ratings_and_random_leaves(spark, monkeypatch):
    """Half of the rated documents train; the others must come out as rated, and clearly less so from random leaves."""
    d = "/root/testdata/sf0.1"
    labels = table(spark, d, "labels").where("doc_id is not null and subject is not null")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    sentences, slots = sb.prepare(table(spark, d, "documents"))
    names = sorted(r.subject for r in table(spark, d, "subjects").collect() if r.subject != sb.GENERAL)
    asked = labels.where(~half).select("doc_id").distinct()
    rated = names_of(labels.where(~half).where("subject <> 'general'"))

    def found():
        model = sb.train(sentences, slots, labels.where(half), names)
        got = names_of(sb.assign(sentences.join(asked, "doc_id", "left_semi"), model))
        pairs = sum(len(got[i] & rated[i]) for i in rated)
        return pairs / sum(len(rated[i]) for i in rated), pairs / sum(len(got[i]) for i in rated)

    recall, precision = found()
    assert recall >= 0.9 and precision >= 0.9
    monkeypatch.setattr(sb, "leaves", lambda points, k=sb.LEAVES: points.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(k)).cast("int").alias("leaf")))
    worse = found()
    assert worse[0] < recall - 0.05 and worse[1] < precision - 0.05


def test_labels_name_the_leaves(spark):
    docs, truth = corpus()
    d, labels, subjects = frames(spark, docs, truth)
    assert {r.subject for r in sb.classify(d, labels.limit(0), subjects)[0].collect()} == {"general"}
    # subjects are what their raters say: other names, other words
    swap = {"software": "chess", "transport": "pottery", "liquor": "weaving"}
    renamed = labels.replace(swap, subset="subject")
    other = spark.createDataFrame([(s, "") for s in [*swap.values(), "general"]], "subject string, name_zh string")
    got = names_of(sb.classify(d, renamed, other)[0])
    assert sum(got[i] == {swap.get(s, s) for s in truth[i]} for i in truth) / len(truth) >= 0.95


def test_words_of_any_length(spark):
    a, b = "x" * 40 + "ab", "x" * 40 + "ba"
    t = sb.cut([f"{a} {b}"])
    assert len(set(t.term.tolist())) == 3  # two words and their pair
    long = "y" * 5000
    t = sb.cut([f"{long} {a}"])
    assert sb.spell(t.codes, 0, sb._WORD) == long and sb.spell(t.codes, 0, sb._PAIR) == f"{long} {a}"


def test_nothing_to_learn(spark):
    docs, truth = corpus(12)
    d, labels, subjects = frames(spark, docs, truth)
    out, _ = sb.classify(d.where("doc_id = 0"), labels.limit(0), subjects)
    assert [r.subject for r in out.collect()] == ["general"]
    assert sb.classify(d.limit(0), labels, subjects)[0].count() == 0


def test_cut_sentences_and_terms():
    t = sb.cut(["净息差3.5，升。Net interest margin rose 3.5. 好", "", "Ab"])
    words = {sb.spell(t.codes, a, x) if x >= sb._WORD else chr(x >> 16) + chr(x & 0xFFFF) for a, x in zip(t.start, t.term.tolist(), strict=True)}
    assert {"净息", "息差", "net", "interest margin", "ab"} <= words and "margin rose" in words
    assert len({s for s, d in zip(t.sentence, t.doc, strict=True) if d == 0}) == 2  # the lone last character is no term
    parts = sb.cut(["来源：my_feed"])
    assert set(sb.cut(["feed"]).term.tolist()).isdisjoint(parts.term.tolist())  # a part of a name is no word
    same = sb.cut(["NET Interest"])
    assert set(same.term.tolist()) <= set(t.term.tolist())


def test_long_texts_are_read_whole():
    tail = "港口群的铁路线"
    text = "平" * 900_000 + "。" + tail
    assert sum(j - i for i, j in sb.steps([text, text])) == 2
    found = sb.cut([text]).term
    assert np.isin(ord("港") * 65536 + ord("口"), found)
