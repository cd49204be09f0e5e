import random
import re

from qalake.operators import corpus


def long_text(rng, n):
    return "".join(rng.choice(["word ", "longer\n", "é", "x" * 70, "日本 ", " \n "]) for _ in range(n))


def test_large_parts_are_split_and_not_cut(spark):
    rng = random.Random(3)
    rows = [(i, long_text(rng, 200) + "\n---\n" + long_text(rng, 60)) for i in range(8)] + [(9, "y" * 1000), (10, "short"), (11, "z" * 50)]
    got = corpus.split_large(spark.createDataFrame(rows, "doc_id long, text string"), 20, 50).orderBy("doc_id", "pos", "sub").collect()
    assert all(0 < len(r.content) <= 50 for r in got)
    for doc, text in rows:
        parts = text.split("\n---\n")
        for pos, part in enumerate(parts):
            own = "".join(r.content for r in got if (r.doc_id, r.pos) == (doc, pos))
            assert own == (part if len(parts) == 1 else part.strip() if len(part.strip()) > 20 else "")  # a text without a boundary stays
    words = [r.content for r in corpus.split_large(spark.createDataFrame([(1, "one two three four")], "doc_id long, text string"), 1, 8).orderBy("sub").collect()]
    assert all(w.strip() in "one two three four".split() or " " in w.strip() for w in words)


def test_long_questions_and_repaired_chunks_keep_their_text(spark):
    rng = random.Random(5)
    text = "\n".join(f"Q{i}: {long_text(rng, n)}" for i, n in enumerate((3, 2000, 4, 900)))
    bare = lambda t: re.sub(r"\s", "", t)
    got = corpus.split_qa(spark.createDataFrame([(1, text)], "doc_id long, text string"), 100, 500).orderBy("pos").collect()
    assert bare("".join(r.content for r in got)) == bare(text) and max(len(r.content) for r in got) <= 500
    got = corpus.repair_oversized(spark.createDataFrame([("a", "faq", text)], "entry_id string, topic string, content string"), 100).orderBy("part").collect()
    assert bare("".join(r.content for r in got)) == bare(text)
