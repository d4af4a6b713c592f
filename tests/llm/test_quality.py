import collections
import re

from foldstone.llm.quality import good_rows, quality

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = W.findall(text)
    wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(wins)
    spots = {j for i, w in enumerate(wins) if count[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if W.search(x)]
    base = len(words) < 10 or 100 * len(spots) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(spots), base


CASES = ["a b c d e a b c d e f", "x " * 40, "l\nl\n\nl \nm", "|a| #b $c", "the cat of a hat and the bat is in it for that man", "a b c d e f g h i j a b c d e a b c d e", "eins\x0bzwei\x0cdrei\r\nvier"]


def test_measures(docs, odd):
    texts = odd + CASES
    got = {r.doc_id: r for r in quality(docs(texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t)
        assert not (r.kept and r.base_failed)
    assert quality(docs([])).count() == 0


def test_rules_drop_junk_and_keep_prose(docs):
    good = "It was the best of times and it was the worst of times for all that lived in the town by the sea."
    bad = [good.replace(" ", " | "), good.upper().replace(" ", "!! ") + "!!", " ".join(w for x in good.split() for w in (x, x)), "### $$$ %%% " * 9]
    table = docs([good, *bad, good])
    assert sorted(r.doc_id for r in quality(table).where("kept").collect()) == [0, 5]
    kept = good_rows(table)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 5]


def test_no_python_in_the_plan(docs):
    plan = quality(docs(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
