import re

from rankloom.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    covered = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    texts = [None, "", " \x0b\n", "a b c d e a b c d e", "a " * 40, "a b c d e f a b c d e x b c d e f", "l\nl\n\nl \nl",
             "é# 日本| x <a>", " lead and trail ", "\n".join(["same line here now please"] * 4), "w" * 30_000]
    df = spark.createDataFrame([(k, t, 9) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judge(df).collect()}
    assert got == {k: brute(t) for k, t in enumerate(texts)}


def test_verdicts(spark):
    good = "the house of the man and the tree is in the garden with a small door for the cat that was there on a day by night"
    rows = [(1, good), (2, good.replace(" ", "# ")), (3, "too short"), (4, " ".join(["zzz yyy"] * 40)),
            (5, "\n".join(" ".join(f"the {w}{k} of" for w in "abcd") for k in range(3))), (6, None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].kept for k in range(1, 7)] == [True, False, False, False, True, False]
    assert got[2].broken_rules == ["symbols"] and not got[2].base_failed and got[3].base_failed and got[4].base_failed


def test_no_python_and_no_shuffle(odd_docs, no_docs):
    out = quality.judge(odd_docs)
    assert out.count() == odd_docs.count() and quality.judge(no_docs).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
