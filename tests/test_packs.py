"""Lines of a stream in packs: what a file's state sees of them, and groups of packs against groups of all lines."""

from __future__ import annotations

import json
import random

import pyarrow as pa

from timberline.streaming import stitch as S

SCHEMA = pa.schema([("file_id", pa.string()), ("at", pa.int64()), *((c, pa.bool_()) for c in S.SEEN[:5]), ("signature", pa.string()), ("frame", pa.string()), ("told", pa.string()), ("line", pa.string())])
START = {"next": 0, "sure": -1, "frame": -1, "entry": None, "orphan": None, "opener": None, "frames": [], "lines": 0}


def made(seed, count):
    rng, rows = random.Random(seed), []
    for k in range(count):
        kind = rng.choice(["empty", "entry", "entry", "frame", "frame", "body", "head"])
        told = {"rank": rng.randint(0, 6), "title": f"t{rng.randint(0, 3)}", "pattern": "p", "who": f"w{rng.randint(0, 9)}", "raw": f"l{k}"} | ({"type": rng.choice("ABC") + "Error"} if kind == "head" or rng.random() < 0.3 else {})
        frame = json.dumps({"k": k}) if kind == "frame" else None
        flags = (kind == "empty", kind in ("frame", "head"), kind == "body", kind == "frame", kind == "head" or "type" in told)
        rows.append(dict(zip(SCHEMA.names, ("f", k * 10, *flags, f"s{rng.randint(0, 2)}", frame, json.dumps(told), None))))
    return rows


def test_a_file_state_sees_only_the_end_of_a_pack():
    rows = made(1, 10_000)
    pack = next(S.packed([pa.RecordBatch.from_pylist(rows, schema=SCHEMA)])).to_pylist()[0]
    assert pack["lines"] == 10_000 and pack["fresh"] and len(json.loads(pack["seen"])) < 100


def test_packs_give_the_rows_and_groups_of_all_lines():
    for seed in range(40):
        rows = made(seed, 300)
        seen = [tuple(r[c] for c in S.SEEN) for r in rows]
        whole = list(S.roles(json.loads(json.dumps(START)), seen))
        cut = random.Random(seed).randint(1, 40)
        state, got, parts, want = json.loads(json.dumps(START)), [], {}, {}
        for k in range(0, len(rows), cut):
            pack = next(S.packed([pa.RecordBatch.from_pylist(rows[k : k + cut], schema=SCHEMA)])).to_pylist()[0]
            table = pa.table({"file_id": ["f"], "start": [json.dumps(state)], "data": pa.array([pack["data"]], pa.binary()), "closed": pa.array([None], pa.string())})
            out = [x for b in S.unpacked(table.to_batches()) for x in b.to_pylist()]
            got += [(x["line_no"], x["role"], x["entry_id"], x["opener"], x["inherited"]) for x in out]
            lines = [x | {"signature": x["opener"]} for x in out if x["role"] in ("entry", "orphan", "continuation")]
            schema = pa.schema([*S.STITCHED_ARROW, ("signature", pa.string())])
            for b in S.folded([pa.RecordBatch.from_pylist(lines, schema=schema)]) if lines else ():
                for g in b.to_pylist():
                    parts[g["signature"]] = S.IssueState.joined(parts.get(g["signature"], S.nothing()), json.loads(g["data"]))
            for x in lines:
                S.IssueState.fold(want.setdefault(x["signature"], S.nothing()), x["line_no"], x["role"], x["inherited"], x["frame"], json.loads(x["told"]))
            seen_now = [tuple(x) for x in json.loads(pack["seen"])]
            state |= {"next": state["next"] + pack["lines"] - len(seen_now), "lines": 0} if pack["fresh"] else {}
            list(S.roles(state, seen_now))
        assert got == [x[:5] for x in whole]
        strip = lambda groups: {s: {k: v for k, v in g.items() if k != "own"} for s, g in groups.items()}
        assert strip(parts) == strip(want)
