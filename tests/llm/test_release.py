"""Replays of conversations against a row-by-row account and against SQL."""

import zlib

import pytest

from skein.llm import queries, release
from tests.compare import rows_of, rows_of_sql


def plain(rows):
    """The contract's columns, one conversation and one turn after the other."""
    text_crc = lambda t: zlib.crc32((t or "").encode())
    shown = lambda x: "" if x is None else str(x)
    out = []
    for conv in {c for c, _, _ in rows}:
        turns = sorted((t is None, t or 0, text_crc(x), t, x) for c, t, x in rows if c == conv)
        done = []
        for p, (_, _, weight, turn, _) in enumerate(turns):
            h = lambda k, turn=turn: zlib.crc32(f"{k}:{shown(conv)}:{shown(turn)}".encode())
            distance, arrival = h(0) % 5, 7 * p
            parent = done[p - distance] if 0 < distance <= p else None
            row = {"conv": conv, "turn": turn, "status": "blocked", "attempts": 0, "first": None, "last": None, "no": None, "state": None, "weight": weight, "p": p}
            done.append(row)
            if parent and parent["status"] != "delivered":
                continue
            at = max(arrival, parent["last"]) if parent else arrival
            faulty, repaired = h(1) % 101 < 50, arrival + h(2) % 101
            row |= {"first": at, "status": "dead"}
            for a in range(1, 7):
                row |= {"attempts": a, "last": at}
                if not faulty or at >= repaired and h(a + 2) % 3 != 0:
                    row["status"] = "delivered"
                    break
                at += 10 * 2 ** (a - 1)
        state = 0
        for no, row in enumerate(sorted((r for r in done if r["status"] == "delivered"), key=lambda r: (r["last"], r["turn"] is None, r["turn"] or 0, r["p"])), 1):
            state += no * row["weight"]
            row |= {"no": no, "state": (state + 2**63) % 2**64 - 2**63}
        out += [tuple(r[k] for k in ("conv", "turn", "status", "attempts", "first", "last", "no", "state")) for r in done]
    return sorted(out, key=repr)


def frame(spark, rows):
    full = [(c, t, "user", x, 1, 2, "k") for c, t, x in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, p int, segment int, key string").repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    sf = f"/root/testdata/{sf}"
    assert rows_of(queries.op11_release(spark, sf)) == rows_of_sql(queries.oracle_sql()["op11_release"], sf)


@pytest.mark.parametrize(("level", "seconds", "pack"), [(12, 15, 1 << 16), (5, 7, 100), (3, 4, 7)])
def test_long_conversations_in_groups_of_any_size(spark, monkeypatch, level, seconds, pack):
    monkeypatch.setattr(release, "PACK", pack)
    monkeypatch.setattr(queries, "REPLAY", {"level": level, "seconds": seconds})
    rows = [(7, t * 3 - 50, f"t{t}") for t in range(2500)] + [(8, 10**12 * t, None) for t in range(40)] + [(c, t, "x" * t) for c in range(100, 160) for t in range(c % 9)]
    assert found(queries.replayed(frame(spark, rows))) == plain(rows)


def test_edges(spark):
    rows = [(1, 0, None), (1, 1, ""), (1, 1, ""), (1, 1, "other"), (1, None, "no turn"), (1, None, None), (None, 0, "no conversation"), (None, 3, "é\U0001f600" * 50_000), (2, -5, "x"), (3, 2**63 - 1, "y"), (3, -(2**63), "z")]
    assert found(queries.replayed(frame(spark, rows))) == plain(rows)


def test_no_rows(spark):
    empty = queries.replayed(frame(spark, []))
    assert empty.collect() == [] and empty.columns == ["conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state"]


def test_state_wraps(spark):
    rows = spark.range(70_000).selectExpr("1 AS k", "id AS turn", "4294967295 AS w")
    from pyspark.sql import functions as F

    got = release.replay(rows, "k", "turn", F.lit(0), F.lit(0), F.col("w"), 4).orderBy("turn").select("state").collect()
    total = 0
    for i, r in enumerate(got, 1):
        total += i * (2**32 - 1)
        assert r.state == (total + 2**63) % 2**64 - 2**63
    assert total > 2**63


def test_no_window_holds_a_long_conversation(spark, monkeypatch):
    """Every window and every join is keyed by a group as well as by the conversation."""
    rows = release.placed(spark.range(100).selectExpr("1 AS key", "id AS turn", "0 AS weight", "0 AS plan", "1 AS distance"), 3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    keys = [x.split("]")[0] for x in plan.split("windowspecdefinition(")[1:]]
    assert keys and all("bucket" in k.split(" ASC")[0] or "above" in k.split(" ASC")[0] for k in keys)
