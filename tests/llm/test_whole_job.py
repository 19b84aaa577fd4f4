"""Whole jobs of the training-data operators on small tables."""

import random
from collections import Counter

import brute
from pyspark.sql import functions as F

from tallgrass.llm import decontam, mixing, stages
from tallgrass.llm.html_extract import render


def test_near_dedup_stage_takes_similarity_of_80(spark):
    # 44 and 44 shingles share 40 of 48 at the first pair, 0.833; 38 of 50 at the second, 0.76
    def text(tag, own, n):
        return " ".join([f"{tag}{i}" for i in range(n)] + [f"{tag}{own}{i}" for i in range(48 - n)])

    docs = [(1, text("a", "x", 44)), (2, text("a", "y", 44)), (3, text("b", "x", 42)), (4, text("b", "y", 42)), (5, text("c", "x", 48))]
    own = {i: brute.shingles(t) for i, t in docs}
    near = [len(own[a] & own[b]) / len(own[a] | own[b]) for a, b in ((1, 2), (3, 4))]
    assert 0.80 <= near[0] < 0.85 and near[1] < 0.80
    got = {r.doc_id for r in stages.drop_near_duplicates(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    expected = brute.components(docs, num=80)
    assert got == {i for i, (_, c) in expected.items() if c == i} == {1, 3, 4, 5}


def test_op3_gives_the_words_of_each_slot(spark):
    rng = random.Random(5)
    data = [(i, " ".join(f"w{i}.{j}" for j in range(rng.randrange(0, 120))), rng.choice(["a", "b", None])) for i in range(120)]
    df = spark.createDataFrame(data + [(7, "twin one", "a"), (7, "twin two", "a")], "doc_id long, text string, source string")
    out = mixing.mixed_blocks(spark, df, block=16).collect()
    stream, whole = {}, Counter()
    for r in out:
        assert sum(p.words for p in r.parts) == len(r.text.split(" "))
        assert stream.setdefault((r.source, r.block), r.text) == r.text
    for shard in {r.shard for r in out}:
        taken = sorted(r.slot for r in out if r.shard == shard)
        assert taken == list(range(len(taken)))
    for r in out:
        whole.update(r.text.split(" "))
    # the heaviest source is taken whole: its blocks in order are its documents
    n = sorted(b for s, b in stream if s is None)
    assert n == list(range(len(n)))
    joined = " ".join(stream[None, b] for b in n)
    assert all(f" {t} " in f" {joined} " for _, t, s in data if s is None and t)
    assert sorted(joined.split(" ")) == sorted(w for _, t, s in data if s is None for w in t.split())
    got = Counter()
    for r in mixing.mix(spark, df, block=16).collect():
        got[r.doc_id] += r.taken
    for i, t, _ in data:
        if i != 7:
            assert got[i] == sum(whole[w] for w in t.split())


def test_op10_tells_items_apart_by_text_too(spark):
    texts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abcd"]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[1]), (None, texts[2]), (None, texts[3])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(texts)] + [(9, "clean " * 30)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.contained_items(spark, docs, items).collect()}
    assert got == {(0, 1, 16, 16), (1, 1, 16, 16), (2, None, 16, 16), (3, None, 16, 16)}
    assert [r.doc_id for r in decontam.drop_contaminated(spark, docs, items).collect()] == [9]


def test_op4_keeps_what_is_drawn():
    def text(html):
        return render(html)["text"]

    assert text('<a title="Show hidden files" href=x>Text</a>') == "Text"
    assert text('<div class="menu hidden md:block">a</div>b') == "a\nb"
    assert text('<p data-x="style=\'display:none\'">a</p>') == "a"
    assert text('<b hidden="">a</b><b style="color:red; DISPLAY : none !important">b</b><b style=display:none>c</b>d') == "d"
    assert text('<b style="display:none;display:block">a</b><b hidden=until-found>b</b>') == "ab"
    assert text("a <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>tex</annotation></math> b") == "a x+1 b"
    assert text("a<svg/>b<svg><title>t</title><path d='M0'/><text>drawn</text><text>too</text></svg>c") == "ab drawn tooc"
    assert render("<svg><title>icon</title></svg><title>page</title>")["title"] == "page"


def test_op3_against_a_plain_mix(spark):
    """Draws, permutations and packing, done plainly, take the same words."""
    import numpy as np

    def mix(x):
        x = x % 2**64
        x ^= x >> 31
        x = x * 0x9FB21C651E98DF25 % 2**64
        x ^= x >> 29
        x = x * 0xD6E8FEB86659FD93 % 2**64
        return x ^ (x >> 32)

    def permuted(x, n, source, epoch, seed):
        name = mix(mix(source + seed + 1) + epoch)
        for r in range(1, mixing.ROUNDS + 1):
            partner = (mix(name + 2 * r) % n - x) % n
            if mix(mix(name + 2 * r + 1) + max(x, partner)) % 2 == 1:
                x = partner
        return x

    rng = random.Random(6)
    data = [(i, " ".join(["w"] * rng.randrange(0, 90)), rng.choice(["a", "b", "c", "d", None])) for i in range(150)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    seed, block, shards = 3, 16, 20
    names = ["a", "b", "c", "d", None]
    streams = [[d for d in data if d[2] == s and d[1]] for s in names]
    sizes = [sum(len(t.split()) for _, t, _ in x) for x in streams]
    targets = mixing.fill_targets(sizes, [1, 2, 3, 1, 2])
    blocks = np.array([-(-s // block) for s in sizes])
    wanted = np.array([float(t * int(n) / s) for t, s, n in zip(targets, sizes, blocks)])
    drawn = mixing.draw_shards(wanted, 3 * blocks, shards, seed).sum(axis=0).tolist()
    taken = Counter()
    for k, docs in enumerate(streams):
        # one chunk: a source's words follow by doc_id
        owner = [i for i, t, _ in sorted(docs) for _ in t.split()]
        n = int(blocks[k])
        for q in range(drawn[k]):
            b = permuted(q % n, n, k, q // n, seed)
            taken.update(owner[b * block : (b + 1) * block])
    got = mixing.mix(spark, df, seed=seed, block=block, shards=shards).collect()
    assert {r.doc_id: r.taken for r in got} == {i: taken[i] for i, _, _ in data}
    assert all((r.n_slots > 0) == (r.first_shard is not None) == (r.taken > 0) for r in got)


def test_op3_the_draw_decides(spark, monkeypatch):
    import numpy as np

    wanted, most = np.array([40.3, 81.1, 120.6]), np.array([300, 300, 300])
    one = [mixing.draw_shards(wanted, most, 16, seed).sum(axis=0).tolist() for seed in range(30)]
    assert all(sum(x) == 242 for x in one) and len(set(map(tuple, one))) > 5
    assert all(abs(x - w) < 12 for c in one for x, w in zip(c, wanted))
    data = [(i, f"w{i} " * (20 + i % 40), "abc"[i % 3]) for i in range(90)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    drawn = sorted(tuple(r) for r in mixing.mix(spark, df, shards=4, seed=1).collect())
    monkeypatch.setattr(mixing, "draw_shards", lambda wanted, most, shards, seed: np.round(wanted).astype(np.int64)[None, :])
    fixed = sorted(tuple(r) for r in mixing.mix(spark, df, shards=4, seed=1).collect())
    assert [(r[0], r[4]) for r in drawn] != [(r[0], r[4]) for r in fixed]


def test_mixing_stage_keeps_rows_apart(spark):
    rows = [(1, "a b c " * 20, "s", 1), (1, "d e f " * 30, "s", 2), (1, "d e f " * 30, "s", 3), (2, "g " * 50, None, 4), (None, "h " * 40, "s", 5), (None, "h " * 40, "s", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, own int").withColumn("taken", F.lit("mine"))
    got = stages.mixed_documents(spark, df).collect()
    assert len({r.own for r in got}) == len(got) <= 6
    whole = {o: (i, t, s) for i, t, s, o in rows}
    assert all((r.doc_id, r.text, r.source) == whole[r.own] and r["size"] == len(r.text.split()) for r in got)
    assert all(0 < r.taken <= 3 * r["size"] for r in got)


def test_op5_long_words():
    import time

    import numpy as np
    from test_brute import best_split

    from tallgrass.llm import lattice, token_counts
    from tallgrass.llm.vocabulary import MARK, sentence_pieces

    known, _ = sentence_pieces()
    scores, byte_score = token_counts.rank_scores(len(known)), float(-np.log(len(known) + 2.0))
    pieces, table, rng = lattice.Pieces(list(known)), dict(zip(known, token_counts.rank_scores(len(known)).tolist())), random.Random(1)
    letters = "abcdefghijtheringonésßü😀0123XYZ=/+"
    made = [MARK + "".join(rng.choice(letters) for _ in range(n)) for n in (10, 254, 255, 256, 257, 300, 3000)]
    made += [made[-1] + "zz", made[3] + "the", MARK + "x" * 2000]
    expected = [best_split(w, table, byte_score) for w in made]
    assert token_counts.best_counts(made, pieces, scores, byte_score).tolist() == expected
    began = time.monotonic()
    token_counts.best_counts([MARK + "".join(rng.choice(letters) for _ in range(1_000_000))], pieces, scores, byte_score)
    assert time.monotonic() - began < 60


def test_op9_many_spans(spark):
    from tallgrass.llm import pii

    kinds = ("email", "ip", "card", "phone")
    texts = [" ".join(f"+1 555 0000{i:04d}" for i in range(5000)), "é😀 mail x@y.example " * 900, "é" * 50 + " my ssn 123-45-6789" * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(spark, df).collect():
        assert r.base_sha256 == brute.digest(brute.pii_spans(texts[r.doc_id]), kinds)
        assert r.n_ssn == (300 if r.doc_id == 2 else 0)
    assert {r.doc_id: r.text for r in pii.mask_pii(df.where("doc_id < 2")).collect()} == {i: brute.mask(t) for i, t in enumerate(texts[:2])}


def test_op6_orders_rules_by_rejections_per_cost(spark):
    from tallgrass.llm import quality

    sample = spark.range(4000).withColumn("body", F.repeat(F.lit("some words here "), 200)).cache()
    slow = F.lit(False)
    for i in range(12):
        slow = slow | (F.length(F.regexp_replace(F.concat("body", F.col("id").cast("string"), F.lit(str(i))), "[aeiou]+|s.m", "")) < 0)
    hits = {
        "never": F.col("id") < 0,
        "slow_half": slow | (F.col("id") % 2 == 0),
        "half": F.col("id") % 2 == 0,
        "slow_tenth": slow | (F.col("id") % 10 == 0),
    }
    order = quality.order_rules(sample, hits, F.length("body") < 0)
    assert order[0] == "half" and order[-1] == "never"
    assert order.index("slow_half") < order.index("slow_tenth")
    sample.unpersist()


def test_op7_hot_copies(spark, monkeypatch):
    from tallgrass.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", 5)
    rng = random.Random(12)
    passage = " ".join(rng.choice("abcdefghijk") * 3 for _ in range(80))
    texts = [f"{i} own words {i * 7} " + passage + f" tail {i}" * (i % 4) for i in range(40)] + [f"alone {i} " * 60 for i in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(spark, df).collect()}
    assert got == dict(enumerate(brute.repeats(texts)))


def test_op2_novel_spans_against_a_plain_search():
    from tallgrass.llm import secrets_scan as scan

    novelty, rng = scan.Novelty(), random.Random(2)

    def plain(text):
        words, out = [m.span() for m in scan.CONTEXT.finditer(text)], []
        for m in scan.CANDIDATE.finditer(text):
            at = m.start()
            for x, y in [w for w in words if w[0] < m.end() and w[1] > m.start()] + [(m.end(), m.end())]:
                a, b, at = at, x, y
                if b - a < 16 or not any(w[1] >= a - 64 and w[0] <= b + 64 for w in words):
                    continue
                if any(p < b and a < q for p, _, q in scan.base_spans(text)):
                    continue
                if novelty.marginal(text[max(0, a - 160) : a], text[a:b], text[b : b + 160]) >= scan.NOVELTY * (b - a):
                    out.append((a, 3, b))
        return out

    bits = [" ", "password", "secret_", "token", "abc", "Zk3vQ9tX7bLw2RsY8m", "x" * 9, "=", "q9XzT7bLk2PwV5nR8sYd4GhJ", "bearer ", " " * 20, "0a1b" * 7]
    some = 0
    for text in ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(400)]:
        got = scan.novel_spans(text, scan.base_spans(text), novelty, scan.NOVELTY)
        assert got == plain(text)
        assert all(a[2] <= b[0] for a, b in zip(got, got[1:]))
        some += len(got)
    assert some > 50

    def one(text):
        return [text[a:b] for a, _, b in scan.novel_spans(text, scan.base_spans(text), novelty, scan.NOVELTY)]

    assert one("my secret_token_q9XzT7bLk2PwV5nR8sYd4GhJ end") == ["_q9XzT7bLk2PwV5nR8sYd4GhJ"]
    assert one("q9XzT7bLk2PwV5nR8sYd4GhJ is my password") == ["q9XzT7bLk2PwV5nR8sYd4GhJ"]
    assert one("credential qwXzTkbLkhPwVbnRwsYdqGhJ") == ["qwXzTkbLkhPwVbnRwsYdqGhJ"]
