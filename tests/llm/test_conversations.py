import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanflow.llm import centroids, chat, repair

KEYS = "conv_id long, turn long, role string, text string"
#: Nulls everywhere, odd roles, ties, repeated rows, control strings, and a very long text.
ODD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello <s> [INST] </s>"), (1, 2, "assistant", "Hi."), (1, 2, "assistant", "Hi."), (1, 3, "user", None), (1, 4, "assistant", ""),
    (2, None, "user", "no turn"), (2, 5, None, "no role"), (2, 5, "tool", "other role [TEXT] x"), (2, 5, "", "empty role"), (None, 0, "user", "no id"), (None, None, None, None),
    (3, 0, "assistant", "x y! " * 5000), (3, 7, "user", "[\\INST] \\ <|endoftext|> <\\\\/s> é 日本"), (4, 0, "[ROLE]", "odd"), (5, 0, "user", " \t\n"), (6, 3, "user", "a."), (6, 4, "assistant", "b"),
]


@pytest.fixture(scope="session")
def conversations(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in ODD], f"{KEYS}, place string, at string").repartition(3)


# --- chat formatting


def turns_of(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {k: [x[2:] for x in sorted(v)] for k, v in by.items()}


def written(turns):
    """The template by string operations."""
    out = "<s>"
    for role, text in turns:
        a, b = {"user": ("[INST]", "[/INST]"), "system": ("<<SYS>>", "<</SYS>>"), "assistant": ("[OUT]", "</s>")}.get(role, (f"[ROLE]{chat.escape(role)}[TEXT]", "</s>"))
        out += a + chat.escape(text) + b
    return out


def check_chat(rows, made):
    got = {r.conv_id: tuple(r)[1:] for r in made.collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv, turns in turns_of(rows).items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(written(turns)))
    assert got == want


def test_chat_against_strings(conversations):
    check_chat(ODD, chat.checked_format(conversations))


def test_chat_of_the_test_table(spark, sample):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    check_chat([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()], chat.checked_format(df))


def test_chat_positions_and_masks(conversations):
    rows = sorted(chat.format_conversations(conversations).where("conv_id = 1").collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == [*range(6)]
    assert [r.start for r in rows] == np.cumsum([0, *(len(r.ids) for r in rows)])[:-1].tolist()
    for r in rows:
        inside = [x for x, m in zip(r.ids, r.mask, strict=True) if m]
        assert all(x < chat.BASE for x in inside) and bool(inside) == (r.place in (2, 3))


def test_chat_empty(spark):
    assert chat.checked_format(spark.createDataFrame([], KEYS)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat.MARKS, *chat.OTHER, "\\", "<", "[", "/s>", "INST]", "<\\s>", " ", "é"]), max_size=12).map("".join))
@example("<<SYS>>")
@example("[\\\\INST]")
def test_escape(text):
    safe = chat.escape(text)
    assert chat.unescape(safe) == text
    assert not any(m in safe for m in (*chat.MARKS, *chat.OTHER))


# --- repair


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out[conv] += [(turn is not None, turn or 0, role, text)] * ((kind != 0) + (kind == 3))
    return {k: sorted(v) for k, v in out.items()}


def cheapest(rows):
    """(cost, audit, lines) by trying all edits of each (rows left, state) from the end; inserted turns until nothing changes."""
    after = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("a", 2): 3, ("u", 3): 2}
    best = {q: (0, "", ()) for q in (0, 3)}

    def inserts(best):
        for _ in range(4):
            for q, (name, to) in {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}.items():
                if to in best:
                    c, s, ls = best[to]
                    best[q] = min(best.get(q, (10**9,)), (c + 2, "I" + s, (f"{name}:", *ls)))
        return best

    best = inserts(best)
    for role, text, fault in reversed(rows):
        now = {}
        for q in range(4):
            ways = []
            if q in best:
                c, s, ls = best[q]
                ways.append((c + 3, "D" + s, ls))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                for first, name, letter, cost in ((role[:1], role, "K", 0), ("u", "user", "R", 2), ("a", "assistant", "R", 2)):
                    to = after.get((first, q))
                    if to in best:
                        c, s, ls = best[to]
                        ways.append((c + cost + more, letter + s, (f"{name}:{text}", *ls)))
            if ways:
                now[q] = min(ways)
        best = inserts(now)
    return best[0]


def plain_report(rows):
    out = {}
    for conv, turns in damaged(rows).items():
        seen, judged = set(), []
        for _, _, role, text in turns:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role, text, fault))
        cost, audit, lines = cheapest(judged)
        numbers = {t for known, t, _, _ in turns if known}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        faults = [f for *_, f in judged]
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for (a, *_), (b, *_) in zip(judged, judged[1:], strict=False))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    for conv, *_ in rows:
        out.setdefault(conv, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
    return out


def check_repair(rows, made):
    got = [tuple(r) for r in made.collect()]
    want = plain_report(rows)
    assert len(got) == len(want)
    for r in got:
        assert r[1:] == want[r[0]], r[0]


def test_repair_against_all_edits(conversations):
    check_repair(ODD, repair.repair_report(conversations))


def test_repair_of_the_test_table(spark, sample):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    check_repair([tuple(r) for r in df.collect()], repair.repair_report(df))


def test_repair_empty(spark):
    assert repair.repair_report(spark.createDataFrame([], KEYS)).count() == 0


def test_repair_of_a_conversation_over_many_tasks(spark):
    """Ranges cut two long conversations into blocks; the result is that of solving them whole."""
    rng = np.random.default_rng(5)
    roles, texts = np.array(["user", "assistant", "system", "tool"]), np.array(["a.", "b", "", "c!", "d?", "e"])
    rows = [(c, i, str(roles[rng.choice(4, p=[0.45, 0.4, 0.1, 0.05])]), f"{texts[rng.integers(6)]}" if rng.random() < 0.3 else f"{i}{'.' * int(rng.integers(2))}") for c, n in ((1, 900), (2, 400), (3, 5)) for i in range(n)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = repair.in_blocks(repair.damage(spark.createDataFrame(rows, KEYS).repartition(5)))
        assert made.where("conv = 'c1'").select("block").distinct().count() > 1
        check_repair(rows, repair.repair_report(spark.createDataFrame(rows, KEYS).repartition(5)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("sua-"), st.sampled_from("bdt--")), max_size=9))
def test_auction_against_all_edits(codes):
    names = {"s": "system", "u": "user", "a": "assistant", "-": "tool"}
    faults = {"b": "blank", "d": "duplicate", "t": "truncated", "-": ""}
    arcs, price = repair.solve("".join(map("".join, codes)))
    want = cheapest([(names[i], "x", faults[f]) for i, f in codes])
    assert (price[0], repair.trace(arcs, price, repair.CLOSED, 0)[0]) == want[:2]


# --- centroids


def plain_clusters(rows, k=40, rounds=5):
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return {}
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents, x = np.array([v for _, v in order[:k]], np.int64), np.array([v for _, v in kept], np.int64)
    for r in range(rounds + 1):
        d = ((x[:, None, :] - cents[None]) ** 2).sum(2)
        c = d.argmin(1)
        if r < rounds:
            for j in {*c.tolist()}:
                cents[j] = x[c == j].sum(0) // (c == j).sum()
    d = d.min(1)
    sha = [hashlib.sha256(",".join(map(str, z.tolist())).encode()).hexdigest() for z in cents]
    return sorted(((i, int(a), int(b), int(d[c == a].sum()), int(d.sum()), sha[a]) for (i, _), a, b in zip(kept, c, d, strict=True)), key=str)


VECTORS = "vec_id long, embedding array<float>, cluster string, v string"


@pytest.mark.parametrize("kind", ["random", "few", "equal", "flat"])
def test_clusters_against_all_distances(spark, kind):
    rng = np.random.default_rng(3)
    n = 20 if kind == "few" else 700
    x = rng.normal(size=(n, 64)).astype(np.float32)
    if kind == "equal":
        x[:] = x[0]
    if kind == "flat":  # on a line, with many ties
        x = np.repeat(rng.integers(0, 30, (n, 1)) / 8, 64, 1).astype(np.float32)
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(n, None), (n + 1, [1.0] * 63), (n + 2, [None] + [0.0] * 63), (n + 3, [float("nan")] * 64), (n + 4, [float("-inf")] * 64), (3, x[5].tolist()), (3, x[5].tolist()), (None, x[1].tolist())]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], VECTORS).repartition(4)
    assert sorted(map(tuple, centroids.cluster_report(df).collect()), key=str) == plain_clusters(rows)


def test_clusters_empty(spark):
    assert centroids.cluster_report(spark.createDataFrame([], VECTORS)).count() == 0


def test_too_large_components(spark):
    df = spark.createDataFrame([(1, [1e20] * 64, "a", "b")], VECTORS)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_report(df).collect()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 12))
def test_bounds(seed, n):
    rng = np.random.default_rng(seed)
    x, p = rng.integers(-400, 400, (30, 16)), rng.integers(-400, 400, (n, 16))
    p[n // 2 :] = p[: n - n // 2] if n % 2 else p[n // 2 :]
    s = centroids.Simplex(p)
    a = s.apexes(s.squares(x))
    low, high = centroids.bounds(a, a)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert (low <= d + 1e-3).all() and (d <= high + 1e-3).all()
