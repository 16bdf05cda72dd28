import base64

import pytest

from quillmesh.llm.encoding import count_tokens, encode_documents, encode_text, load_ranks, vocabulary_path

tiktoken = pytest.importorskip("tiktoken")
TEXTS = [
    "", None, " ", "Hello world's <|endoftext|>\r\n\t x", "naïve ½ Ⅷ ٣٤ 漢字かな 👩‍🔧  ", "a" * 2000 + "bcde" * 300, "\x1c\x85　_ __ 'll'LL", "é" * 700, "x\n\n\n y", "￿ﬁ",
]


@pytest.fixture(scope="module")
def reference():
    public = pytest.importorskip("public_tokenizers")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary_path(), "rb"))}
    return tiktoken.Encoding("check", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_documents(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] * 2, "doc_id long, text string, ids string")
    got = encode_documents(df).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        text = TEXTS[r["doc_id"]]
        assert r["ids"] == (None if text is None else reference.encode_ordinary(text))
    counts = {r["doc_id"]: r["tokens"] for r in count_tokens(df, ["doc_id"]).collect()}
    assert counts == {i: len(reference.encode_ordinary(t)) if t else 0 for i, t in enumerate(TEXTS)}


def test_corpus_and_round_trip(spark, data_dir, reference):
    ranks = {v: k for k, v in load_ranks(vocabulary_path()).items()}
    for row in spark.read.parquet(f"{data_dir}/documents.parquet").filter("text is not null").collect():
        ids = encode_text(row["text"]) if row["text"] else []
        assert ids == reference.encode_ordinary(row["text"]) and b"".join(ranks[i] for i in ids).decode() == row["text"]


def test_random_strings(reference):
    hypothesis = pytest.importorskip("hypothesis")

    @hypothesis.settings(max_examples=300, deadline=None)
    @hypothesis.given(hypothesis.strategies.text(alphabet=hypothesis.strategies.characters(exclude_categories=["Cs", "Cn"])))
    def same(text):
        assert (encode_text(text) if text else []) == reference.encode_ordinary(text)

    same()


def test_empty_table(spark):
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
