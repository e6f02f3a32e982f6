"""The pipeline's last stage gives the ids themselves."""

import hashlib

import corpus_pipeline


def test_last_stage_gives_token_ids(spark):
    import public_tokenizers
    import tiktoken

    from lectern.llm import bpe

    own = {1: "Some words, and  more.", 2: "", 3: None, 4: "é 12345 \n x"}
    df = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}, special_tokens={})
    got = {r.doc_id: r for r in dict(corpus_pipeline.STAGES)["byte_bpe"](spark, df, None).collect()}
    assert set(got) == set(own)
    for i, t in own.items():
        ids = other.encode_ordinary(t or "")
        assert (got[i].token_ids, got[i].n_tokens) == (ids, len(ids))
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
