"""What the pieces operator leaves on the disk before it deals texts."""

from affinis.llm import pieces


def test_shuffles_of_chunks_and_paths_go_before_texts_are_dealt(spark, monkeypatch):
    freed = []
    monkeypatch.setattr(pieces, "freed", freed.append)
    docs = spark.createDataFrame([(1, "a word and another word"), (2, None)], "doc_id long, text string")
    out = pieces.encode(docs, pieces.model_of(spark), both=False)
    assert len(freed) == 1  # once everything that is written has been, before texts are read again
    assert {r.doc_id: r.n_ids > 0 for r in out.collect()} == {1: True, 2: False}
