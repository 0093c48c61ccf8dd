from difflib import SequenceMatcher

from rollbook.plans import sections


def test_similarity_reads_whole_turns(spark, tmp_path):
    long = "the same opening words " * 10
    turns = [(1, 0, "user", long + "alpha"), (1, 1, "assistant", long + "omega and much that differs " * 5), (1, 2, "user", "abc"), (2, 0, "user", "xyz"), (2, 1, "assistant", None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.ratio for r in sections.n9_similarity(spark, str(tmp_path)).collect()}
    assert got == {(1, 0): round(SequenceMatcher(None, turns[0][3], turns[1][3]).ratio(), 6), (2, 0): None}
