from collections import Counter

from meterwork.llm.line_quality import Judge, LineRules, judged, repeat_words
from tests.llm.conftest import AWKWARD


def brute_repeat(words):
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts, inside = Counter(windows), set()
    for i, w in enumerate(windows):
        if counts[w] > 1:
            inside |= {i, i + 1, i + 2}
    return len(inside)


def test_repeat_words_equal_brute_force():
    import random

    rng = random.Random(3)
    for _ in range(500):
        words = [rng.choice([b"a", b"b", b"cc"]) for _ in range(rng.randrange(0, 15))]
        assert repeat_words(words) == brute_repeat(words)


def test_lines_fail_by_their_rule():
    judge = Judge(LineRules())
    assert judge.line(b"A whole sentence ends here.", 5) is None
    assert judge.line("Ein Satz »endet« hier.".encode(), 4) is None
    assert judge.line(b"no closing mark at all", 5) == "punctuation"
    assert judge.line(b"BUY!! NOW!! HERE!!", 3) == "punctuation"
    assert judge.line(b"Home | News | About | Contact.", 7) == "navigation"
    assert judge.line(b"Please accept cookies to go on.", 6) == "boilerplate"


def test_failing_lines_go_then_documents(docs, prose):
    good = prose(1, 60)
    bad = "\n".join(["menu | home | more | less"] * 3) + "\n" + good
    lost = "\n".join(f"shout{i}!! shout!! {i}!!" for i in range(60)) + "\n" + good
    got = {r["doc_id"]: r for r in judged(docs([(1, good), (2, bad), (3, lost), (4, "too short.")])).collect()}
    assert got[1]["kept"] and got[1]["clean_text"] == good
    assert got[2]["kept"] and got[2]["clean_text"] == good and got[2]["n_dup_lines"] == 2 and got[2]["lines_punctuation"] == 3
    assert not got[3]["kept"] and not got[3]["base_failed"]
    assert got[4]["base_failed"] and not got[4]["kept"]


def test_awkward_rows(docs, spark):
    got = judged(docs(AWKWARD)).collect()
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[1]["n_words"] == by[2]["n_words"] == by[3]["n_words"] == 0 and by[1]["base_failed"]
    assert by[7]["word_chars"] == 300_000 and by[8]["word_chars"] == 50 * 5 and by[9]["n_repeat_words"] == 120_000
    assert judged(docs(AWKWARD).limit(0)).count() == 0
