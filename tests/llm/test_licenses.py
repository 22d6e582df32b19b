import random
import re

import pytest

from meterwork.llm import licenses, queries
from meterwork.llm.licenses import PHRASES, TEMPLATES, Chains, Scanner, ScanRules, scanned, words_of
from tests.llm.conftest import AWKWARD

SMALL = ScanRules(
    phrases=(("one", "a b"), ("two", "b a b")), templates=(("x", "a b c a b d"), ("y", "c a b c"), ("z", "b b b b b"), ("x", "d c b a d")),
    min_run=2, max_gap=3, min_share=0.6)


def slow_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def slow_places(words, phrases):
    found = []
    for label, phrase in phrases:
        p = slow_words(phrase)
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(found)


def slow_runs(words, template, least):
    """All runs common to a text and a template that no word to either side prolongs: (text end, template end, length)."""
    runs = []
    for i in range(len(words)):
        for j in range(len(template)):
            if words[i] != template[j] or (i and j and words[i - 1] == template[j - 1]):
                continue
            n = 0
            while i + n < len(words) and j + n < len(template) and words[i + n] == template[j + n]:
                n += 1
            if n >= least:
                runs.append((i + n, j + n, n))
    return sorted(runs)


def slow_share(words, rules):
    """The best chain over all pairs of runs, none forgotten."""
    best = 0.0
    for _, text in rules.templates:
        template, cover = slow_words(text), []
        for end, at, n in slow_runs(words, template, rules.min_run):
            here = n
            for e, a, c in cover:
                if e < end and a < at and (end - n) - e <= rules.max_gap and (at - n) - a <= rules.max_gap:
                    here = max(here, c + min(n, end - e, at - a))
            cover.append((end, at, here))
            best = max(best, here / len(template))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_anchors_and_chains_equal_brute_force(seed, monkeypatch):
    rng = random.Random(seed)
    scanner = Scanner(SMALL)
    seen = []
    plain = Chains.anchor
    monkeypatch.setattr(Chains, "anchor", lambda self, *x: (seen.append(x), plain(self, *x))[1])
    for piece in (7, 1 << 20):
        monkeypatch.setattr(licenses.pieces, "__defaults__", (piece,))
        for _ in range(60):
            words = [rng.choice("aabbbccdq") for _ in range(rng.randrange(0, 40))]
            seen.clear()
            got = scanner.scan(" ".join(words).encode())
            runs = sorted((end, at, n, SMALL.templates[k - len(SMALL.phrases)][1]) for k, at, n, end in seen)
            assert runs == sorted((*r, t) for _, t in SMALL.templates for r in slow_runs(words, slow_words(t), SMALL.min_run))
            places = slow_places(words, SMALL.phrases)
            assert got.n_words == len(words) and sorted(got.places) == places
            assert got.share == pytest.approx(1.0 if places else slow_share(words, SMALL))
            assert all(s[4] >= SMALL.min_share and s[1] < s[2] for s in got.spans)
            assert bool(got.spans) == (slow_share(words, SMALL) >= SMALL.min_share)


def test_words():
    assert words_of("All RIGHTS-reserved_é 4.0 ÀB\x7f漢字".encode()) == [w.encode() for w in slow_words("All RIGHTS-reserved_é 4.0 ÀB\x7f漢字")]


def test_every_template_is_found_in_itself_and_after_edits():
    scanner, rng = Scanner(), random.Random(4)
    for label, text in TEMPLATES:
        assert label in {s[0] for s in scanner.scan(("word " * 30 + text + " word" * 30).encode()).spans}
        words = text.split()
        if len(words) > 40:  # a few words changed, lines indented by comment marks
            for _ in range(3):
                words[rng.randrange(len(words))] = "changed"
            edited = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
            spans = [s for s in scanner.scan(("code here\n" + edited + "\nmore code").encode()).spans if s[0] == label and s[2] - s[1] > 30]
            assert len(spans) == 1 and max(s[4] for s in spans) < 1
    assert not scanner.scan(b"the license of the software is not the point of this work and that is it " * 50).spans


def test_copies_of_a_licence_are_separate_spans():
    text = (TEMPLATES[1][1] + " other words in between " * 20) * 3
    spans = [s for s in Scanner().scan(text.encode()).spans if s[4] == 1.0 and s[2] - s[1] > 40]
    assert len(spans) == 3 and spans[0][2] <= spans[1][1] < spans[1][2] <= spans[2][1]


def test_awkward_rows(docs):
    rows = AWKWARD + [(20, "cc by " * 3 + "All rights reserved."), (21, "x " * 200_000 + TEMPLATES[1][1]), (22, "of the software " * 20_000)]
    got = scanned(docs(rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (1, 2, 3):
            assert (r["n_words"], r["places"], r["spans"], r["score"]) == (0, [], [], 0.0)
    by = {r["doc_id"]: r for r in got}
    assert [(p["first"], p["label"]) for p in by[20]["places"]] == [(0, "cc-by"), (2, "cc-by"), (4, "cc-by"), (6, "reserved")] and by[20]["score"] == 1.0
    assert {s["label"] for s in by[21]["spans"]} == {"apache-2.0"} and by[21]["spans"][0]["first"] == 200_000
    assert by[8]["n_words"] == len(slow_words("é ß 漢字 🙂 " * 50)) and not by[22]["spans"]
    assert scanned(docs(rows).limit(0)).count() == 0


def test_query(spark, docs, tmp_path, prose):
    rng, rows = random.Random(1), []
    lines = ["All rights reserved.", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3.", ""]
    for i in range(40):
        parts = [prose(i * 9 + k, 40) for k in range(3)]
        parts.insert(rng.randrange(4), rng.choice(lines))
        rows.append((i, "\n".join(parts)))
    docs(rows, clash=False).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op12_license_scan(spark, str(tmp_path)).collect()}
    own = {"Licensed under CC BY-NC 4.0.": "cc-by-nc-4.0", "Released under the MIT License.": "mit", lines[3]: "gpl-3.0"}
    for doc, text in rows:
        words, places = slow_words(text), slow_places(slow_words(text), PHRASES)
        r, base = got[doc], sorted({k for _, k in places})
        more = sorted({*base, *(v for line, v in own.items() if line in text)})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(words), len(places), ",".join(base)) and r["labels"] == ",".join(more)
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None)) and 0 <= r["score"] <= 1
