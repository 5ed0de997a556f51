"""Contaminated words against a plain search of every window."""

import random
import re

from llm_fixtures import awkward, folded, prose

from allelespan.llm import decontamination


def words_of(text):
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text).encode())]


def expected(text, items):
    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add("null" if name is None else str(name))
    return len(words), sorted(hit), sorted(found)


def found_in(df, benchmark, **options):
    rows = decontamination.contamination(df, benchmark, **options).collect()
    return [(r.text, (r.n_words, [k for s in r.hit_spans for k in range(s.start, s.stop)], r.hit_items)) for r in rows]


def items():
    rows = [(k, prose(900 + k, n)) for k, n in enumerate((9, 10, 11, 30, 3, 1, 60))]
    return [*rows, (7, None), (8, ""), (9, "- _ -"), (10, rows[3][1]), (3, rows[3][1]), (None, prose(990, 12)), (11, "É1 " + prose(991, 11))]


def test_equals_the_plain_search(frame):
    rnd, benchmark = random.Random(3), items()
    texts = []
    for k in range(80):
        part = words_of(rnd.choice([t for _, t in benchmark if t]))
        cut = part[rnd.randrange(len(part)) :] if part and k % 2 else part
        texts.append(f"{prose(k, rnd.randrange(0, 30))}! {' - '.join(cut).upper()}, {prose(700 + k, 9)}")
    texts += [None, "", prose(990, 12) + " " + prose(990, 12)]
    df, table = frame(list(enumerate(texts)), "doc_id bigint, text string"), frame(benchmark, "item_id bigint, text string")
    want = {t: expected(t, benchmark) for t in texts}
    assert sum(bool(w[1]) for w in want.values()) > 40
    assert dict(found_in(df, table)) == want
    assert dict(found_in(df, table, block_windows=20)) == want  # several blocks


def test_awkward_rows(odd, nothing, frame):
    benchmark = frame(items(), "item_id bigint, text string")
    got = found_in(odd, benchmark)
    assert len(got) == len(awkward())
    assert all(e == expected(t, items()) for t, e in got)
    none = frame([], "item_id bigint, text string")
    assert {tuple(e[1]) for _, e in found_in(odd, none)} == {()}
    assert decontamination.contamination(nothing, benchmark).count() == 0


def test_prefix_is_the_rarest_shingle(frame):
    item = prose(1, 10)
    common = " ".join(item.split()[:7])
    df = frame([(k, common + " " + prose(50 + k, 5)) for k in range(20)] + [(99, item)], "doc_id bigint, text string")
    windows = decontamination.item_windows(frame([(1, item)], "item_id bigint, text string"), 10, 5).collect()
    wanted = [decontamination._Shingles.of(5, __import__("numpy").array(windows[0].shingles).view("u8"))]
    lookup = decontamination._lookups(windows, wanted, decontamination._rarity(df, "text", wanted))[0]
    assert lookup.offset[0] >= 3  # the first three shingles lie in the common words
