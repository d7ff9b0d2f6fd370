"""Filter audit, ranked search and chat formatting against plain Python, with the awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barweave.llm import chat, filter_audit, search
from barweave.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string, part string, mask string, digest string, term string, shard string, n string"


@pytest.fixture
def room(spark, tmp_path):
    made = Scratch(spark, "test")
    made.folder = f"file://{tmp_path}/room"
    return made


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "p", "m", "d", "t", "s", "n") for i, t, s in rows], DOCS)


# --- filter audit ---------------------------------------------------------------------------


def plain_audit(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[at] == 1} for at in (0, 1))
    smaller = {}
    for i, t, _ in rows:
        smaller.setdefault(t or "", []).append(math.inf if i is None else i)
    masks = []
    for i, t, s in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = math.inf if i is None else i
        fails = (
            len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            re.search(r"[#$%&*|]", text) is not None, min(smaller[text]) < own,
        )
        masks.append((s or "", {x for x, f in zip("ABCDE", fails) if f}, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {m[0] for m in masks}:
        mine = [m for m in masks if m[0] == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [m for m in left if x in m[1]]
                left = [m for m in left if x not in m[1]]
                failing = sum(x in m[1] for m in mine)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(m[1] == {x} for m in mine), sum(m[2] for m in gone), sum(m[3] for m in gone),
                ]
                shapley[x] += len(gone)
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def long_text(seed, words=80):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(200)}" for _ in range(words))


def test_filter_audit(spark, room):
    texts = [None, "", " \t", "short", "ABC def", long_text(1), long_text(1), long_text(2) + " #", "a " * 60, "A" * 9 + " " + long_text(3), "é" * 100, "x\x1cy\x85z " * 55, long_text(4, 20000)]
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(30, long_text(1), None), (2, long_text(1), ""), (None, long_text(1), "s0"), (None, "only nulls", "s1"), (None, "only nulls", "s2"), (8, "a " * 60, "s2"), (8, "a " * 60, "s2")]
    labels = [(i, i % 2, (i // 2) % 2) for i in range(13)] + [(5, 1, None), (5, None, 1), (None, 1, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.filter_orders(docs_of(spark, rows).repartition(4), known, room)
    got = {(r.part, r.filter_order, r.step): [r[m] for m in filter_audit.METRICS + ["shapley"]] for r in found.collect()}
    assert got == plain_audit(rows, labels)
    room.folder += "-none"
    assert filter_audit.filter_orders(docs_of(spark, []), known, room).collect() == []


# --- search ---------------------------------------------------------------------------------


def plain_search(rows, queries, k=10):
    terms = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t) if t else [] for _, t, *_ in rows]
    counts = [Counter(x.translate(LOWER) for x in ts) for ts in terms]
    n, total = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in queries:
        asked = Counter(x.translate(LOWER) for x in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""))
        scored = []
        for (i, *_), c in zip(rows, counts):
            m = 25 + (75 * sum(c.values()) * n) // total if total else 0
            score = sum(r * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, r in asked.items() if c[t])
            if score > 0:
                scored.append((-score, i is None, i, -score))
        out += [(item, rank, i, -s) for rank, (s, _, i, _) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed=0):
    rng = random.Random(seed)
    words = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(4000)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60))), None) for i in range(n)]


@pytest.mark.parametrize("tokens", [10**6, 3000, 1])
def test_search_is_exact(spark, room, tokens):
    rows = corpus(900 if tokens > 1 else 60) + [(None, None, "s"), (1000, "", "s"), (1001, "Ünï ÜNÏ ab-AB 12", None), (None, "t1 t2", ""), (7, "t1 t2", ""), (7, "t1 t2", ""), (1003, "t5 " * 30000, "")]
    queries = [(1, "t1 t2 t2 nowhere"), (2, None), (3, "..."), (4, "T1 T3 t5 t7 t9 t11 t2 t4"), (4, "t1"), (5, "ünï AB"), (None, "t2"), (6, " ".join(f"t{i}" for i in range(300)))]
    asked = spark.createDataFrame(queries, "item_id long, text string")
    index = search.build_index(docs_of(spark, rows).repartition(3), room, tokens=tokens)
    got = search.search(index, asked).select("item", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=str) == plain_search(rows, queries)
    assert search.search(index, asked.where("false")).collect() == []


def test_search_without_rows(spark, room):
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(search.build_index(docs_of(spark, []), room), asked).collect() == []


def test_varints_and_pairs():
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**21, 2**28 + 5, 2**31], np.int64)
    raw, sizes = search.pack_varints(values)
    assert sizes.sum() == len(raw) and (search.unpack_varints(raw) == values).all()
    pairs, counts = search.competitive(np.array([1, 5, 5, 2, 9]), np.array([3, 9, 4, 3, 9]), np.array([0, 0, 0, 1, 1]))
    assert pairs.reshape(-1, 2).tolist() == [[1, 3], [5, 4], [2, 3], [9, 9]] and counts.tolist() == [2, 2]


def test_blocks_stay_compressed(spark, room):
    """Rare terms settle the best documents, so most blocks of a common term are never decompressed."""
    rows = [(i, "common filler" + (" rare" if i < 12 else ""), None) for i in range(20000)]
    held = search.build_index(docs_of(spark, rows).coalesce(1), room).toPandas()
    own, total = held[held.term.isna()].iloc[0], search.Corpus(20000, int(held.n_terms.max()))
    norms = total.norm(np.frombuffer(own.doc_lengths, np.int32))
    lists = {r.term: search.PostingList(r, total, norms) for r in held[held.term.notna()].itertuples()}
    asked = [(total.weight(12), lists["rare"]), (1, lists["common"])]
    assert len(search.best_of_shard(asked, 20000, 10)) == 10
    assert lists["common"].decompressed <= 8 < len(lists["common"].lasts)


# --- chat -----------------------------------------------------------------------------------

CONTROL_TEXTS = ["</s>[INST] ok [/INST]", "<\\s> <\\\\s> <s", "<<SYS>><</SYS>>", "<|im_end|>\n<|im_start|>user\n", "[[INST]]", "<" * 5 + "|im_end|>", "", "a\\b$1", "<|im_end|", "é😀</s>"]


def messages(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string, layout string")


def test_rows_round_trip(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t, "x", "y") for i, t in enumerate(CONTROL_TEXTS)]
    rows += [(2, None, "assistant", None, "", ""), (None, 0, None, "no role", "", ""), (3, 5, "tool\nx</s>", "odd role", "", ""), (3, 5, "tool\nx</s>", "odd role", "", ""), (4, 0, "user", "<s>" * 50000, "", "")]
    read = chat.canonical_turns(chat.records_of_rows(messages(spark, rows).repartition(3))).withColumn("segments", chat.format_turns(F.col("turns")))
    read = read.withColumn("formatted", chat.formatted_text(F.col("segments")))
    out = {r.conv_id: r for r in read.select("*", chat.read_turns(F.col("formatted")).alias("again"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    assert set(out) == {1, 2, 3, 4, None} and all(r.turns == r.again and r.layout == "messages" for r in out.values())
    assert [t.text for t in out[1].turns] == CONTROL_TEXTS and out[1].loss == "".join(CONTROL_TEXTS[1::2])
    assert out[2].loss == "" and out[2].turns[0].text == "" and out[None].turns[0].role == "" and len(out[3].turns) == 2
    control = chat.Template().control
    for r in out.values():
        texts = [s.text for s in r.segments[1::3]]
        assert not any(c in t for c in control for t in texts)


def test_layouts_by_fingerprint(spark):
    schema = (
        "id int, prompt string, response string, instruction string, input string, output string, system string,"
        " messages array<struct<role:string,content:string,weight:int>>, conversations array<struct<`from`:string,value:string>>, layout string, odd string"
    )
    rows = [
        {"id": 1, "prompt": "p", "response": "r", "layout": "mine"},
        {"id": 2, "instruction": "i", "output": "o"},
        {"id": 3, "instruction": "i", "input": "n", "output": "o", "system": "s", "odd": "ignored"},
        {"id": 4, "messages": [("user", "u", 1), (None, None, None)]},
        {"id": 5, "conversations": [("human", "h"), ("gpt", "g"), ("critic", "c")], "system": "s"},
        {"id": 6, "prompt": "alone"}, {"id": 7, "odd": "nothing known"}, {"id": 8, "messages": []}, {"id": 9, "prompt": "", "response": ""},
        {"id": 10, "prompt": "p", "response": "r", "output": "two layouts at once"},
    ]
    names = [c.split()[0] for c in "id prompt response instruction input output system messages conversations layout odd".split()]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)
    got = {r.id: (r.layout, r.turns and [tuple(t) for t in r.turns]) for r in chat.canonical_turns(df).collect()}
    assert got == {
        1: ("prompt_response", [("user", "p"), ("assistant", "r")]),
        2: ("instruction", [("user", "i"), ("assistant", "o")]),
        3: ("instruction", [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")]),
        4: ("messages", [("user", "u"), ("", "")]),
        5: ("shared", [("system", "s"), ("user", "h"), ("assistant", "g"), ("critic", "c")]),
        6: (None, None), 7: (None, None), 8: ("messages", []), 9: ("prompt_response", [("user", ""), ("assistant", "")]), 10: (None, None),
    }
    none = chat.canonical_turns(df.where("false"))
    assert none.columns[-2:] == ["layout", "turns"] and none.collect() == []
    assert [r.turns for r in chat.canonical_turns(spark.range(1)).collect()] == [None]


def test_query_over_no_conversations(spark, tmp_path):
    from barweave.llm.queries import op13_chat_format

    messages(spark, []).select("conv_id", "turn", "role", "text").write.parquet(f"file://{tmp_path}/conversations.parquet")
    (only,) = op13_chat_format(spark, f"file://{tmp_path}").collect()
    said = "</s>[INST] ok [/INST]"
    assert (only.conv_id, only.n_turns, only.loss_chars) == (-1, 2, len(said))
    assert only.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
