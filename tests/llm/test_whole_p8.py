"""No topical term is left out of the vocabulary."""

from factloom.llm import subjects


def test_every_topical_term_is_kept(spark):
    letters = "abcdefghij"
    word = lambda i: "w" + "".join(letters[int(c)] for c in f"{i:05d}")
    docs = [(g * 3 + j, ". ".join(word(g * 100 + i) for i in range(100) for _ in range(5))) for g in range(60) for j in range(3)]
    found = subjects.vocabulary(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.example for r in found.collect()} == {word(i) for i in range(6000)}
