"""Web pages, scans, conversations and answers: labelled small cases, plain-Python versions and edge cases."""

from __future__ import annotations

import random
import unicodedata
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import answers, conversations, language, pages, scans
from sparkloom.llm.queries import REGISTRY
from sparkloom.runtime import table


def test_tree_matching_pairs_blocks_in_order():
    tree = lambda blocks: pages.tree_of([k for k, xs in blocks for _ in xs], [x for _, xs in blocks for x in xs])
    a = tree([(0, [1, 2]), (6, [3, 4, 5]), (3, [7]), (6, [9])])
    b = tree([(0, [2]), (4, [7]), (6, [3, 5]), (3, [8]), (6, [4])])
    assert set(pages.aligned(a, b)) == {(0, 2), (6, 3), (6, 5)}
    # What changed places matches in a later alignment.
    assert pages.matched(a, b) == {(0, 2), (6, 3), (6, 4), (6, 5)}
    assert pages.matched(a, tree([(1, [1])])) == set() == pages.matched({}, b)
    assert pages.aligned(tree([(6, [1, 2, 3, 4])]), tree([(6, [4, 1, 3, 2])])) in ([(6, 1), (6, 2)], [(6, 1), (6, 3)])


def test_addresses(spark):
    urls = ["http://www.a.example/x/?q=1", "https://a.example/x#top", "HTTPS://WWW.a.example/x", "a.example/x/", None, ""]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(pages.address(F.col("u"))).collect()]
    assert got[:4] == ["a.example/x"] * 4 and got[4:] == [None, ""]


def test_surroundings_of_pages(spark):
    rng = random.Random(2)
    chunks, want, saved = [], set(), []
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    for k in range(60):
        site = "s1" if k % 3 else "s2"
        url = f"https://www.{site}.example/p{k}"
        saved.append((site, url if k % 2 else url.replace("www.", "") + "/", "downloaded", "data/raw/html/p.md"))
        title = f"{word()} {word()}"
        lines = [(f"Home / {word()} / {title}", 1), (f"About {site} | Contact {site} | News of {site} | Help", 1), ("", 0), (f"## {title}", 0), (f"The {word()} of the {word()} is {word()}.", 0), (f"| {word()} | {word()} |", 0), ("- " + word(), 0)]
        if k % 4 == 0:
            lines += [("You may also like", 1), (f"{word()} for {word()} | 1234{k % 10}", 1), (f"[{word()}](https://x.example/p/{k})", 1)]
        lines += [(f"**Visitors so far: {rng.randrange(10**6)}**" if k % 5 == 0 else f"Visitors so far: {rng.randrange(10**6)}", 1)]
        chunks.append((f"c{k}", site, url, "\n".join(x for x, _ in lines)))
        want |= {(f"c{k}", n) for n, (_, out) in enumerate(lines, 1) if out}
    chunks += [chunks[0], ("n", "s1", saved[0][1], None), ("e", "s1", saved[0][1], ""), ("o", "s1", "https://elsewhere.example", "Visitors so far: 1"), (None, None, None, "x"), ("u", "s1", None, "Home / a / b"), ("m", None, saved[0][1], "only\nmain")]
    c = spark.createDataFrame(chunks, "chunk_id string, source_id string, url string, text string").withColumn("sig", F.lit(1)).withColumn("kind", F.lit(1))
    d = spark.createDataFrame([*saved, (None, None, None, None)], "id string, url string, status string, path string")
    got = {tuple(r) for r in pages.surroundings(c, d).collect()}
    assert got == want
    # The alignments decide: without them nothing constant is found.
    assert not {tuple(r) for r in pages.surroundings(c, d, peers=0).collect()} & want
    body = {r.chunk_id: r.text for r in pages.main_bodies(c, d).collect()}
    assert body["e"] == "" and body["m"] == "only\nmain" and "Visitors" not in "".join(body.values()) and "o" not in body
    assert pages.surroundings(c.limit(0), d).count() == 0 and pages.surroundings(c, d.limit(0)).count() == 0


def test_skeletons_join_what_recognition_mixes_up():
    same = [("within", "withln"), ("mark", "rnark"), ("water", "vvater"), ("sectional", "sectiorial"), ("instrument", "instriiment"), ("furnish", "furriish"), ("standards", "5tanclards"), ("register", "regisfer"), ("official", "offi¢ial"), ("reading", "reàding"), ("failing", "failinq"), ("harvanda", "harvancla")]
    for right, wrong in same:
        assert any(scans.skeleton(right, p) == scans.skeleton(wrong, p) for p in scans.ORDERS), (right, wrong)
    assert scans.bad_number("20l4") and scans.bad_number("4OS21") and not any(map(scans.bad_number, ["2014", "m2", "IS", "12th", "x"]))


def test_scans(spark):
    rng = random.Random(4)
    common = "the holder of a licence shall keep the record of each sample drawn within the works and return the report to the office".split()
    clean = [(f"k{k}", "book", 900 + k, " ".join(rng.choice(common) for _ in range(400))) for k in range(80)]
    scanned, want = [], set()
    for p in range(1, 31):
        lines = [("Gazette of Orders, Part IX: lamps" if p % 5 else "Gazette of 0rders, Part lX: lamps", {"furniture"})]
        lines += [(" ".join(rng.choice(common) for _ in range(8)), set()), ("sarnple of the licence", {"glyph"}), ("within 2O days of the rec-", {"glyph", "split"}), ("ord drawn", set()), ("", set()), ("977", set()), ("kept well-", {"split"}), ("known in the works. 5", set()), ("the ofﬁce", {"glyph"}), (" ".join(rng.choice(common) for _ in range(8)), set()), (f"- {p} -", {"furniture"})]
        scanned.append((f"s{p}", "scan", p, "\n".join(x for x, _ in lines)))
        want |= {(f"s{p}", n, k) for n, (_, kinds) in enumerate(lines, 1) for k in kinds}
    odd = [scanned[0], ("n", "scan", 1, None), ("e", "scan", 2, " \n"), (None, "scan", 3, "x"), ("w", "scan", None, "withln"), ("o", "other", 1, "withln"), (None, None, None, None)]
    c = spark.createDataFrame(clean + scanned + odd, "chunk_id string, source_id string, page int, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(1))
    p = spark.createDataFrame([("scan", list(range(1, 31))), ("scan", [1, None]), ("none", None), (None, [1])], "source_id string, ocr_pages array<int>")
    assert {tuple(r) for r in scans.repairs(c, p).collect()} == want
    # The vectors decide: without them no word is corrected.
    zero = lambda seqs, ids: (np.zeros((len(ids), scans.DIMS)), np.zeros((len(ids), scans.DIMS)))
    blind = {tuple(r) for r in scans.repairs(c, p, zero).collect()}
    assert blind <= want and {x for x in want - blind} == {(f"s{k}", 3, "glyph") for k in range(1, 31)}
    text = {r.chunk_id: r.text for r in scans.repaired(c, p).collect()}
    assert "sample of the licence within 20 days of the record drawn" in text["s1"] and "Gazette" not in text["s1"] and "the office" in text["s1"]
    assert scans.repairs(c.limit(0), p).count() == 0 and scans.repairs(c, p.limit(0)).count() == 0


def test_each_occurrence_is_corrected_in_its_context(spark):
    """One misread word that stands for two others, told apart by the words beside it."""
    rng = random.Random(6)
    left, right = ["spins on the steel shaft with oil", "carries a heavy load in the wheel"], ["before the court of appeal was held", "of both parties was closed by the judge"]
    clean = [(f"k{k}", "book", 900 + k, " ".join(f"the bearing {rng.choice(left)} and the hearing {rng.choice(right)} so" for _ in range(8))) for k in range(120)]
    pages, want = [], {}
    for k in range(1, 31):
        # Furniture is looked for in the two outer lines.
        a, b, outer = left[k % 2], right[k // 2 % 2], [clean[k][3], clean[k + 80][3]]
        pages.append((f"s{k}", "scan", k, "\n".join([*outer, f"the bearirig {a}", clean[k + 40][3], f"the bearirig {b}", *outer[::-1]])))
        want[f"s{k}"] = " ".join([*outer, f"the bearing {a}", clean[k + 40][3], f"the hearing {b}", *outer[::-1]])
    c = spark.createDataFrame(clean + pages, "chunk_id string, source_id string, page int, text string")
    p = spark.createDataFrame([("scan", list(range(1, 31)))], "source_id string, ocr_pages array<int>")
    text = {r.chunk_id: r.text for r in scans.repaired(c, p).collect()}
    assert text.keys() == want.keys() and sum(text[k] == want[k] for k in want) >= 0.9 * len(want)


def plain_reasons(rows):
    names = {n: k for k, v in conversations.SPEAKERS.items() for n in v.split()}
    shown = lambda s: [c for c in s if not c.isspace() and unicodedata.category(c)[0] not in "ZC"]
    of = defaultdict(set)
    for sid, no, role, text, _ in rows:
        if sid is not None:
            role = (role or "").strip().lower()
            of[sid.strip().lower()].add((no, names.get(role, role) or None, (text or "").strip()))
    out = {}
    for sid, turns in of.items():
        spoken = sorted((t for t in turns if t[1] in ("user", "assistant") and t[0] is not None))
        if not any(shown(t[2]) for t in turns if t[1] in ("user", "assistant")):
            out[sid] = "empty"
        elif any(t[0] is None or t[1] is None for t in turns) or sorted(t[0] for t in turns) != list(range(1, len(turns) + 1)):
            out[sid] = "broken"
        elif any(t[1] == "assistant" and (k == 0 or spoken[k - 1][1] != "user") for k, t in enumerate(spoken)):
            out[sid] = "broken"
        elif any(t[1] == "user" and not (k + 1 < len(spoken) and spoken[k + 1][1] == "assistant" and shown(spoken[k + 1][2])) for k, t in enumerate(spoken)):
            out[sid] = "missing_reply"
    return out


def test_conversations_of_the_table(spark, sf_dir):
    turns = table(spark, sf_dir, "turns")
    rows = [tuple(r) for r in turns.select("session_id", "turn_no", "role", "text", "created_at").collect()]
    want = plain_reasons(rows)
    assert {r.session_id: r.reason for r in conversations.left_out(turns).collect()} == want
    kept = conversations.conversations(turns).collect()
    assert {r.session_id for r in kept} == {r[0].strip().lower() for r in rows if r[0]} - set(want)


def test_conversations_of_odd_turns(spark):
    rng, now = random.Random(9), datetime(2025, 1, 1)
    rows = []
    for k in range(150):
        n = 1
        for _ in range(rng.randint(0, 5)):
            rows.append((f"s{k}", n, rng.choice(["user", "Human ", "USER"]), f"About IS {k}?", now + timedelta(minutes=n)))
            n += 1
            if rng.random() < 0.2:
                rows.append((f"S{k} ", n, "tool", "{}", now))
                n += 1
            if rng.random() < 0.95:
                rows.append((f"s{k}", n, rng.choice(["assistant", "bot"]), rng.choice(["Yes.", "IS is fine", "​", "", None] + ["ok"] * 9), now + timedelta(minutes=n)))
                n += 1
        if rng.random() < 0.15:
            rows.append((f"s{k}", rng.choice([None, n + 1, 1]), rng.choice([None, "user", " "]), "x", None))
    # A long session spans many blocks of turn numbers.
    rows += [("long", i, "user" if i % 2 else "assistant", f"turn {i}", now + timedelta(seconds=i)) for i in range(1, 1201)]
    rows += [(None, 1, "user", "x", now), ("", 1, "user", "x", now), ("dup", 1, "user", "hi", now), ("dup", 1, "human", "hi ", now), ("dup", 2, "ai", "yo", now)]
    df = spark.createDataFrame(rows, "session_id string, turn_no int, role string, text string, created_at timestamp").withColumn("place", F.lit(1)).withColumn("parent", F.lit(1))
    assert {r.session_id: r.reason for r in conversations.left_out(df).collect()} == plain_reasons(rows)
    kept = conversations.conversations(df).collect()
    dup = [(r.position, r.speaker, r.reply_to, r.tree) for r in sorted(kept, key=lambda r: r.position) if r.session_id == "dup"]
    assert dup == [(1, "user", None, 1), (2, "assistant", 1, 1)]
    long = [r for r in kept if r.session_id == "long"]
    assert len(long) == 1200 and {r.tree for r in long} == {1}
    assert conversations.left_out(df.limit(0)).count() == 0 and conversations.conversations(df.limit(0)).count() == 0


TURN = "session_id string, turn_no int, role string, text string, created_at timestamp"


def test_interleaved_talks_part_into_trees(spark):
    """Two users ask in turn; each answer goes to the question it mentions, which isn't the turn before."""
    now, rows, n = datetime(2025, 1, 1), [], 0
    for k in range(3):
        a, b = 111 + k, 222 + k
        for role, text in (
            ("user", f"What does IS {a} say of lamps and their holders?"),
            ("user", f"Does IS {b} cover ropes made of steel wire?"),
            ("assistant", f"IS {a} says of lamps that their holders are marked."),
            ("assistant", f"IS {b} covers ropes of steel wire."),
        ):
            n += 1
            rows.append(("s", n, role, text, now + timedelta(hours=k, minutes=n)))
    once = conversations.turns_once(spark.createDataFrame(rows, TURN))
    links = {r.place: r.parent for r in conversations.reply_links(conversations.placed(once)).collect()}
    assert [links[p] for p in (3, 4, 7, 8, 11, 12)] == [1, 2, 5, 6, 9, 10]
    # Questions of their own open trees.
    assert all(links[p] is None for p in (2, 5, 6, 9, 10))
    # Without mentions and overlap the answers would go elsewhere.
    blind = conversations.WEIGHTS | {"mention": 0.0, "overlap": 0.0}
    links = {r.place: r.parent for r in conversations.reply_links(conversations.placed(once), weights=blind).collect()}
    assert links[3] == 2


def test_a_reply_far_behind_its_question_finds_it(spark):
    now = datetime(2025, 1, 1)
    rows = [("s", 1, "user", "What is the fee for galvanised buckets under IS 4711?", now)]
    for k in range(150):
        rows += [("s", 2 * k + 2, "user", f"How wide is item {k:c}?", now + timedelta(minutes=k)), ("s", 2 * k + 3, "assistant", "It is so.", now + timedelta(minutes=k))] if k else [("s", 2, "assistant", "One moment.", now), ("s", 3, "user", "Thanks.", now)]
    rows = [(s, n, r, t, c) for n, (s, _, r, t, c) in enumerate(rows, 1)]
    rows.append(("s", len(rows) + 1, "assistant", "The fee for galvanised buckets under IS 4711 is Rs. 100.", now))
    turns = spark.createDataFrame(rows, TURN)
    links = {r.place: (r.parent, r.before) for r in conversations.reply_links(conversations.placed(conversations.turns_once(turns))).collect()}
    assert links[len(rows)] == (1, "assistant")


def test_sessions_are_judged_by_the_chosen_links(spark):
    """Two answers in a row, the second to an earlier question: the link jumps, and the exact check says what stands before."""
    now = datetime(2025, 1, 1)
    talk = lambda s, *turns: [(s, n, r, t, now + timedelta(minutes=n)) for n, (r, t) in enumerate(turns, 1)]
    rows = talk("straight", ("user", "IS 1?"), ("assistant", "IS 1."), ("user", "IS 2?"), ("assistant", "IS 2."))
    rows += talk("crossed", ("user", "IS 111 for lamps?"), ("user", "IS 222 for ropes?"), ("assistant", "Lamps: IS 111."), ("assistant", "Ropes: IS 222."))
    rows += talk("late", ("user", "IS 111 for lamps with holders?"), ("assistant", "Wait."), ("user", "Hm?"), ("assistant", "IS 111 for lamps with holders it is."))
    turns = spark.createDataFrame(rows, TURN)
    assert {r.session_id: r.reason for r in conversations.left_out(turns).collect()} == {"crossed": "broken"}
    # Without scores no link is likely enough, and no assistant follows anyone.
    none = dict.fromkeys(conversations.WEIGHTS, 0.0)
    assert {r.session_id: r.reason for r in conversations.left_out(turns, weights=none).collect()} == dict.fromkeys(["straight", "crossed", "late"], "broken")


CASES = [
    ("Is the mark compulsory for lamps?", "", False, "empty"),
    ("Is the mark compulsory for lamps?", None, False, "empty"),
    ("Is the mark compulsory for lamps?", "**Short answer**:\n\n**Sources:**\n[1] Rules, p. 2 | https://x.example/a.pdf", False, "empty"),
    ("Is the mark compulsory for lamps?", "ERROR: TimeoutError: the read timed out", False, "empty"),
    ("Is the mark compulsory for lamps?", "[1][2]", False, "empty"),
    ("Is the mark compulsory for lamps?", "No.", False, None),
    ("What is the fee?", "Rs. 17,000", False, None),
    ("Is the mark compulsory for lamps?", "You asked: is the mark compulsory for lamps", False, "copy"),
    ("Is the mark compulsory for lamps?", "Is the mark compulsory for lamps? Yes, since the order of 2020 every lamp needs it.", False, None),
    ("Is the mark compulsory for lamps?", "I am sorry, but I can't help with this one. Kindly rephrase.", False, "refusal"),
    ("Tell me a joke.", "I am sorry, but I can't help with this one. Kindly rephrase.", True, None),
    ("Is the mark compulsory for lamps?", "Every lamp is stamped with the licence number. This part is not covered in the documents.", False, None),
    ("Is the mark compulsory for lamps?", "The sample drawn at the works must be sent to the", False, "truncated"),
    ("Is the mark compulsory for lamps?", "The sample drawn at the works must be sent to the office (", False, "truncated"),
    ("Is the mark compulsory for lamps?", "The sample is sent to the office [1][2]\n\n**Sources:**\n[1] Rules, p. 2 | https://x.example/a.pdf", False, None),
    ("Is the mark compulsory for lamps? Please answer in Hindi.", "The sample drawn at the works must be sent to the regional laboratory within ten days.", False, "language"),
    (None, "The sample drawn at the works must be sent to the regional laboratory.", None, None),
    # Wordings of refusals that the tables don't have.
    ("Is the mark compulsory for lamps?", "I am not in a position to comment on lamps.", False, "refusal"),
    ("Is the mark compulsory for lamps?", "Sorry, we cannot share that. Please contact the branch.", False, "refusal"),
    ("Is the mark compulsory for lamps?", "I would prefer not to speculate about it.", False, "refusal"),
    ("Is the mark compulsory for lamps?", "The holder cannot share the mark with another maker.", False, None),
]


def test_answers(spark, sf_dir):
    samples = table(spark, sf_dir, "lang_samples")
    rows = [(str(k), q, a, m) for k, (q, a, m, _) in enumerate(CASES)]
    rows += [rows[0], ("long", "q?", "word " * 30_000 + "end.", False), (None, None, None, None)]
    df = spark.createDataFrame(rows, "id string, question string, answer string, must_refuse boolean").withColumn("defect", F.lit("clash"))
    got = {r.id: r.defect for r in answers.defects(df, samples).collect()}
    assert {k: d for k, d in got.items() if k not in (None, "long")} == {str(k): d for k, (*_, d) in enumerate(CASES) if d}
    assert answers.defects(df.limit(0), samples).count() == 0


def test_the_suffix_automaton_measures_copies():
    a = answers.SuffixAutomaton("abcabxabcd")
    assert a.covered("zzabcdzzabx", 3) == (7, 4) and a.covered("", 1) == (0, 0) and answers.SuffixAutomaton("").covered("abc", 1) == (0, 0)


def test_blocks_tell_where_a_copy_may_be():
    rng = random.Random(3)
    for _ in range(2000):
        asked = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        said = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        longest = answers.SuffixAutomaton(asked).covered(said, 1)[1]
        assert answers.may_copy(asked, said) or longest < answers.STRETCH * len(asked)


def test_every_query_is_registered():
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 9)} | {"p7_ids", "p8_mix", "p8_report"} <= set(REGISTRY.queries)
    assert language.label("English") == "en"
