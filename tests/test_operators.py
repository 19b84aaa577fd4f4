"""Operators against small models and recorded cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallgrass.operators import admission as A
from tallgrass.operators import evidence as E
from tallgrass.operators import history as H
from tallgrass.operators import ledger as L
from tallgrass.operators import retrieval as R
from tallgrass.operators import scoring as S
from tallgrass.operators import shelf as K
from tallgrass.operators import web as W
from tallgrass.sources import journal as J
from tallgrass.sources import store


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_last_forty(spark):
    df = spark.createDataFrame([("s", i) for i in range(1, 45)], "k string, seq long")
    assert [r.seq for r in H.last_n(df, ["k"], ["seq"], 40).orderBy("seq").collect()] == list(range(5, 45))


def test_latest_task_ignores_longer_old_log(spark):
    df = spark.createDataFrame(
        [("t", 100, 5, 900, "a", 1, "old"), ("t", 200, 1, 2, "b", 1, "new"), ("t", 200, 1, 2, "c", 1, "tie")],
        "task_id string, created_at long, time_ms long, seq long, path string, line long, mark string",
    )
    assert [r.mark for r in H.latest_tasks(df).collect()] == ["new"]


def test_fold_keeps_absent_and_takes_null(spark):
    df = spark.createDataFrame(
        [("s", "m", 1, {"a": "1", "b": "x"}), ("s", "m", 2, {"a": "2"}), ("s", "m", 3, {"b": None})],
        "session_id string, message_id string, seq long, payload map<string,string>",
    )
    assert rows(H.fold_messages(df, ["a", "b"]), "position", "seq", "a", "b") == [(1, 3, "2", None)]


def test_task_only_turn_goes_before_the_first_later_turn(spark):
    m = spark.createDataFrame([("s", "a", 1, 100), ("s", "b", 2, 300)], "session_id string, turn_id string, seq long, time_ms long")
    t = spark.createDataFrame([("s", "x", 200), ("s", "y", 900), ("s", "b", 310)], "session_id string, turn_id string, time_ms long")
    got = H.turn_timeline(m, t).orderBy("position").collect()
    assert [r.turn_id for r in got] == ["a", "x", "b", "y"]
    assert [r.tasks for r in got] == [0, 1, 1, 1]


def test_char_budget_always_keeps_the_newest(spark):
    df = spark.createDataFrame([("s", 1, "aa"), ("s", 2, "bb"), ("s", 3, "c" * 50)], "k string, seq long, t string")
    assert rows(H.char_budget(df, ["k"], "seq", "t", 10), "seq") == [(3,)]


def journal(*lines, end="\n"):
    head = '{"schema":"v1","type":"session","version":1,"sessionId":"s","ownerId":"o"}'
    return ("\n".join([head, *lines]) + end).encode()


def line(seq, session="s"):
    return json.dumps({"schema": "v1", "sessionId": session, "seq": seq, "time": "t", "type": "x", "payload": {"a": seq}})


@pytest.mark.parametrize(
    ("content", "state", "events"),
    [
        (journal(line(127), line(136)), "ok", 2),
        (journal(line(1), '{"torn', end=""), "torn", 1),
        (journal(line(1), line(2), end=""), "ok", 2),
        (journal(line(1), '{"bad', line(3)), "damaged", 0),
        (journal(line(2), line(2)), "damaged", 0),
        (journal(line(1, "other")), "damaged", 0),
        (journal(line(1)) + "{\"é".encode()[:-1], "torn", 1),
        (b"", "damaged", 0),
        (b"not json\n", "damaged", 0),
    ],
)
def test_journal_files(spark, content, state, events):
    files = spark.createDataFrame([("f", content)], "path string, content binary")
    found, states = J.decode_journals(files)
    assert [r.state for r in states.collect()] == [state]
    assert found.count() == events


def test_journal_on_disk(spark, tmp_path):
    for i, data in enumerate([journal(line(1)), journal("{")]):
        (tmp_path / f"o{i}" / "s").mkdir(parents=True)
        (tmp_path / f"o{i}" / "s" / J.JOURNAL_FILE).write_bytes(data)
        (tmp_path / f"o{i}" / "other.txt").write_text("x")
    files = J.read_journals(spark, str(tmp_path))
    _, states = J.decode_journals(files)
    assert tuple(J.inspect(states).first()) == (2, 1, 0)
    assert files.count() == 2


def test_append_continues_after_gap(spark):
    held = spark.createDataFrame([("s", "a", 127), ("s", "b", 136)], "session_id string, event_id string, seq long")
    drafts = spark.createDataFrame([("s", "b", 1), ("s", "c", 2), ("s", "c", 3), ("s", None, 4)], "session_id string, event_id string, pos long")
    assert rows(J.append_events(held, drafts), "pos", "seq") == [(2, 137), (4, 138)]


def test_skipped_file_costs_no_budget(spark):
    files = spark.createDataFrame([("a", 5), ("b", 100), ("c", 4)], "path string, bytes long")
    assert rows(J.within_caps(files, 5, 10), "path") == [("a",), ("c",)]


def test_segments_are_injective(spark):
    names = ["a/b", "a_b", "é", "", "a+b", "??>"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "x string").select(J.segment(F.col("x"))).collect()]
    assert len(set(got)) == len(names) and not any(c in "/+=" for g in got for c in g)


def test_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 2), (2, "b", 2)], "id long, v string, schema_version int")
    new = spark.createDataFrame([(1, "a", 2), (2, "c", 1)], "id long, v string, schema_version int")
    store.save_snapshot(old, str(tmp_path), 1)
    store.save_snapshot(new, str(tmp_path), 2)
    good, bad = store.load_snapshot(spark, str(tmp_path), 2)
    assert rows(good, "id", "v") == [(1, "a")] and rows(bad, "id", "v") == [(2, "c")]
    assert rows(store.changed(old, new, "id"), "id") == [(2,)]


def test_audit_log(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    store.append_audit(df, str(tmp_path / "a"))
    store.append_audit(df, str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 2


def test_cases_with_line_numbers(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id":1}\n\nnope\n{"id":2}\n')
    good, bad = K.read_cases(spark, str(tmp_path))
    assert rows(good, "line") == [(1,), (4,)] and rows(bad, "line", "raw") == [(3, "nope")]


OBS = "owner_id string, session_id string, field string, value string, relation string, at long, seq long"
DAY = 86_400_000


def test_evidence_rules(spark):
    data = [
        ("o", "s1", "occupation", "chef", None, 0, 1), ("o", "s1", "occupation", "chef", None, 1, 2),
        ("o", "s2", "occupation", "pastry chef", "refine", 2, 3), ("o", "s3", "occupation", "driver", None, 3, 4),
        ("p", "s1", "occupation", "chef", None, 0, 1), ("p", "s2", "occupation", "chef", None, 91 * DAY, 2),
        ("q", "s1", "occupation", "chef", None, 0, 1), ("q", "s1", "occupation", "chef", None, 90 * DAY, 2),
    ]
    got = rows(E.fold_evidence(spark.createDataFrame(data, OBS)), "owner_id", "value", "confirm", "sessions")
    assert got == [("o", "driver", 1, 1), ("p", "chef", 1, 1), ("q", "chef", 2, 1)]


def test_list_cap_drops_weakest_then_oldest(spark):
    data = [("o", "s", "special_skills", f"v{i}", None, i, i) for i in range(6)]
    data += [("o", "s2", "special_skills", "v0", None, 10, 10), ("o", "s2", "special_skills", "new", None, 11, 11)]
    got = rows(E.fold_evidence(spark.createDataFrame(data, OBS)), "value")
    assert got == [("new",), ("v0",), ("v2",), ("v3",), ("v4",), ("v5",)]


def test_digest_ranks(spark):
    data = [("o", 1, ["Trip"], ["x"], "y", 5), ("o", 2, ["a"], ["trip plan"], "y", 9), ("o", 3, ["a"], ["x"], "a TRIP.", 10), ("o", 4, ["a"], ["x"], "y", 11)]
    df = spark.createDataFrame(data, "owner_id string, session_id long, topics array<string>, work array<string>, gist string, at long")
    assert [r.session_id for r in E.search_digests(df, "trip", 5).orderBy("place").collect()] == [1, 2, 3]
    assert [r.session_id for r in E.search_digests(df, "", 2).orderBy("place").collect()] == [4, 3]


def test_turn_citations_are_stable(spark):
    items = spark.createDataFrame(
        [("t", 1, "https://h/a"), ("t", 2, "https://h/b#x"), ("t", 3, "https://h/b"), ("t", 4, "https://h/c"), ("t", 5, "ftp://h")], "turn_id string, pos long, url string"
    )
    got = rows(W.cite_turn(items), "url", "citation_id")
    assert got == [("https://h/a", "source_1"), ("https://h/b", "source_2"), ("https://h/c", "source_3")]


def test_second_result_page(spark):
    html = '<li class="res-list x"><h3><a href="https://a/1">One &amp;lt;</a></h3><p class="res-desc">d</p></li>'
    df = spark.createDataFrame([(1, html)], "id long, p string")
    assert rows(W.parse_results(df, "id", "p", "res-list"), "url", "title", "snippet") == [("https://a/1", "One <", "d")]


def naive_chunks(markdown, n=1600):
    out, heading, body = [], "", ""

    def flush():
        nonlocal body
        text = body.strip()
        out.extend((heading, text[i : i + n]) for i in range(0, len(text), n))
        body = ""

    import re

    for line_ in re.split(r"\r?\n", markdown):
        m = re.match(r"#{1,6}\s+(.+)$", line_)
        if m:
            flush()
            heading = m[1].strip()
            continue
        add = ("\n" if body else "") + line_
        if len(body) + len(add) > n and body.strip():
            flush()
        body += add
    flush()
    return out


def test_chunks_against_model(spark):
    rng = random.Random(3)
    texts = ["", "# only", "a" * 4000, "# A\n" + "b" * 1599 + "\nc\n## B\nd", "\n\n x \n"]
    texts += ["\n".join(rng.choice(["# H %d" % i, "w " * rng.randrange(900), ""]) for i in range(12)) for _ in range(15)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in R.chunks(df, ["doc_id"], "text").orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append((r.heading, r.text))
    # a line over the limit opens its chunk again with the line break's text
    for i, t in enumerate(texts):
        assert [x for x in got.get(i, [])] == [(h, c) for h, c in naive_chunks(t)], i


def naive_rate(events, window, most):
    state, out = {}, []
    for src, name, seq, t in events:
        s = state.setdefault((src, name), [None, 0])
        if s[0] is None or t - s[0] >= window:
            s[:] = [t, 0]
        s[1] += 1
        out.append((src, name, seq, s[1] <= most))
    return sorted(out)


def test_folds_ignore_partitioning(spark):
    rng, t, data = random.Random(5), 0, []
    for i in range(400):
        t += rng.randrange(0, 40)
        data.append((rng.randrange(3), rng.choice("ab"), i, t))
    df = spark.createDataFrame(data, "source long, name string, seq long, time_ms long")
    expected = naive_rate(data, 100, 4)
    for parts in (1, 3, 7):
        got = A.rate_limit(df.orderBy(F.rand(parts)).repartition(parts), 100, 4)
        assert rows(got, "source", "name", "seq", "accepted") == expected


def test_dedup_ttl_bound_is_included(spark):
    df = spark.createDataFrame([(1, 1, "a", 0), (1, 2, "a", 300_000), (1, 3, "a", 300_001)], "source long, seq long, id string, time_ms long")
    assert rows(A.dedup_ttl(df), "seq", "duplicate") == [(1, False), (2, True), (3, False)]


def test_quota_skips_and_goes_on(spark):
    data = [("a", 9, "o1", None), ("b", 8, "o1", None), ("c", 7, "o1", None), ("d", 6, "o2", "l"), ("e", 5, "o3", "l"), ("f", 4, "o4", None), ("g", 3, "o5", None)]
    df = spark.createDataFrame(
        [(1, i, "queued", p, 0, o, lane, None) for i, p, o, lane in data],
        "pool long, id string, status string, priority long, created_at long, owner_id string, lane string, lane_limit int",
    )
    assert rows(L.admitted(df).where("admitted"), "id") == [("a",), ("b",), ("d",), ("f",)]


def test_reconcile_prefers_later_lifetime(spark):
    j = spark.createDataFrame([("x", 100, "old"), ("y", 300, "j")], "id string, created_at long, status string")
    c = spark.createDataFrame([("x", 200, "new"), ("y", 300, "c"), ("z", 1, "only")], "id string, created_at long, status string")
    assert rows(L.reconcile(j, c), "id", "status") == [("x", "new"), ("y", "j"), ("z", "only")]


def call(name, turn=0, path="/", **arguments):
    return {"turn_index": turn, "path": path, "name": name, "arguments": arguments}


def test_alignment():
    expected = [call("a"), call("b", x=1), call("c")]
    actual = [call("a"), call("extra"), call("b", x=1, y=2), call("c", turn=1)]
    got = S.align(expected, actual)
    assert [(i, j) for i, j, _ in got] == [(0, 0), (None, 1), (1, 2), (2, 3)]
    assert got[2][2]["arguments"] and not got[3][2]["turn"]
    better = S.align([call("a", x=1)], [call("a"), call("a", x=1)])
    assert [(i, j) for i, j, _ in better] == [(None, 0), (0, 1)]
    assert S.align([call("vehicle_closure_control", target="trunk")], [call("vehicle_closure_control", target="rear_trunk")])[0][2]["arguments"]
    assert not S.compare(call("a", x=1) | {"exact_arguments": True}, call("a", x=1, y=2))["arguments"]


def test_alignment_is_best():
    rng = random.Random(1)

    def weight(pairs):
        return sum(100 + 4 * p["arguments"] + 2 * p["turn"] + p["path"] for i, j, p in pairs if i is not None and j is not None)

    def best(e, a):
        if not e or not a:
            return 0
        p = S.compare(e[0], a[0])
        take = 100 + 4 * p["arguments"] + 2 * p["turn"] + p["path"] + best(e[1:], a[1:]) if p["name"] else 0
        return max(take, best(e[1:], a), best(e, a[1:]))

    for _ in range(60):
        make = lambda: [call(rng.choice("ab"), rng.randrange(2), x=rng.randrange(2)) for _ in range(rng.randrange(6))]
        e, a = make(), make()
        assert weight(S.align(e, a)) == best(e, a)


def test_summary_without_checkpoints_is_null(spark):
    df = spark.createDataFrame([("d", 0, 0, 0, 0, True, 0)], "domain string, expected_calls long, actual_calls long, checkpoints long, checkpoints_passed long, passed boolean, hit long")
    got = S.summary(df, ["passed"], ["hit"]).where("overall = 1").first()
    assert got["checkpoint_rate"] is None and got["passed_rate"] == 1.0 and got["hit_accuracy"] == 0.0


def test_library_import(spark):
    held = spark.createDataFrame([("o", "a", "p1", "f0", 1)], "owner_id string, id string, path string, fingerprint string, imported_at long")
    new = spark.createDataFrame(
        [("o", "b", "p1", "md", "text", 2), ("o", "c", "p2", "exe", "x", 3), ("o", "d", "p3", "txt", "text", 4)],
        "owner_id string, id string, path string, extension string, content string, imported_at long",
    )
    assert rows(store.import_documents(held, new), "id") == [("d",)]


def naive_lists(data, cap=6, stale=E.STALE_MS):
    """Slots of a list field as a plain list per owner, oldest slot first."""
    owners = {}
    for owner, session, _, value, relation, at, _ in sorted(data, key=lambda r: r[-1]):
        held = owners.setdefault(owner, [])
        slot = next((s for s in held if s[0] == value), None)
        if slot is None:
            while len(held) >= cap:
                held.remove(min(held, key=lambda s: (s[1], s[3])))
            held.append([value, 1, {session}, at])
            continue
        if at - slot[3] > stale:
            slot[1], slot[2] = 0, set()
        if relation == "contradict":
            slot[1], slot[2] = 1, {session}
        else:
            slot[1] += 1
            slot[2].add(session)
        slot[3] = at
    return sorted((o, s[0], s[1], len(s[2]), s[3]) for o, held in owners.items() for s in held)


@pytest.mark.parametrize("seed", range(3))
def test_list_evidence_against_model(spark, seed):
    rng, t, data = random.Random(seed), 0, []
    for i in range(400):
        t += rng.randrange(1, 6 * DAY)
        relation = rng.choice([None, None, None, "refine", "contradict"])
        data.append((f"o{rng.randrange(3)}", f"s{rng.randrange(9)}", "special_skills", f"v{rng.randrange(10)}", relation, t, i))
    got = rows(E.fold_evidence(spark.createDataFrame(data, OBS)), "owner_id", "value", "confirm", "sessions", "last_at")
    assert got == naive_lists(data)


def test_positional_pairs(spark):
    cases = spark.createDataFrame(
        [("c", json.dumps([call("a"), call("b", x=1), call("c")]), json.dumps([call("a", turn=1), call("x", x=1)])), ("d", None, None)],
        "case_id string, expected string, actual string",
    )
    assert rows(S.positional(cases), "i", "name", "arguments", "turn", "path") == [
        (0, True, True, False, True), (1, False, True, True, True), (2, False, True, False, False),
    ]
