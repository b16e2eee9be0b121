import json

from tessera.llm import toolcalls as tc

SCHEMAS = {"add": {"a": ("number", True), "b": ("number", True), "note": ("string", False)}, **tc.REPLY}


def calls(*xs):
    return json.dumps({"tool_calls": list(xs)})


def call(i, after=(), name="add", **arguments):
    return {"id": i, "name": name, "arguments": arguments, "after": list(after)}


ROWS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", 'What "is"\n2+3?'), (1, 2, "assistant", calls(call("x", a=2, b=3.50), call("y", ["x"], b=1, a=2), call("z", ["y", "gone"], a="2", b=1, c=0))),
    (1, 3, "tool", json.dumps({"tool_call_id": "x", "content": {"sum": 5, "at": [1]}})), (1, 4, "tool", json.dumps({"tool_call_id": "x", "content": "again"})),
    (1, 5, "tool", json.dumps({"tool_call_id": "nobody", "content": None})), (1, 6, "assistant", "Five."), (2, 0, "user", "hello"), (2, 1, "assistant", "é hi"), (2, 1, "assistant", "another"),
    (3, 0, "user", None), (3, 1, "assistant", "{not json"), (4, 0, "assistant", calls(call("p", ["q"], a=1, b=1), call("q", ["p"], a=1, b=1), call("r", ["q"], a=1, b=1), call(None, a=1, b=1), call("w", name="odd"))),
    (5, 0, "user", "twice"), (5, 0, "user", "twice"), (None, None, "user", "lost"), (6, None, None, None), (7, 0, "assistant", json.dumps({"tool_calls": [{"id": "v", "name": "add", "arguments": "text"}]})),
]


def test_link(spark):
    df = spark.createDataFrame([(t, c, n, r, "extra") for c, n, r, t in ROWS], "text string, conv_id long, turn long, role string, json string").repartition(3)
    rows = tc.link(df, SCHEMAS).collect()
    got = {(r["call_id"], r["turn"], r["kind"]): r for r in rows if r["call_id"]}
    assert {k[0]: (r["status"], r["level"]) for k, r in got.items() if k[2] == "call"} == {
        "1:1": ("pending", 0), "x": ("linked", 0), "y": ("pending", 2), "z": ("invalid", 4), "2:0": ("linked", 0), "3:0": ("invalid", 0), "p": ("cyclic", -1), "q": ("cyclic", -1), "r": ("cyclic", -1),
        "w": ("invalid", 0), "5:0": ("ambiguous", 0), "v": ("invalid", 0),
    }
    x = got["x", 2, "call"]
    assert x["n_results"] == 2 and x["json"] == '{"arguments":{"a":2,"b":3.5},"errors":[],"id":"x","level":0,"name":"add","result":{"at":[1],"sum":5}}'
    assert json.loads(got["z", 2, "call"]["json"])["errors"] == ["type of a", "unknown c"]
    assert json.loads(got["2:0", 0, "call"]["json"])["result"] == "another" and got["2:0", 0, "call"]["n_results"] == 2
    assert json.loads(got["1:1", 1, "call"]["json"])["arguments"] == {"text": 'What "is"\n2+3?'}
    assert json.loads(got["v", 0, "call"]["json"])["errors"] == ["arguments are no object"]
    assert sum(r["status"] == "orphan" for r in rows) == 2 and sum(r["status"] == "ambiguous" for r in rows) == 2
    assert {r["status"] for r in rows if r["call_id"] is None} == {"message", "pending"}
    for r in rows:
        assert json.dumps(json.loads(r["json"]), ensure_ascii=False, sort_keys=True, separators=(",", ":")) == r["json"]
    linked_results = sum(r["n_results"] for r in rows if r["kind"] == "call" and r["status"] != "ambiguous")
    assert len(rows) == 14 + 2 + 3 and linked_results == 5


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    out = tc.link(df)
    assert out.count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


def brute(rows, schemas):
    """Events one by one, chains by recursion."""
    dumps = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    kinds = {"number": (int, float), "string": (str,)}
    calls, results, out = [], [], []
    for conv, turn, role, text in rows:
        v = json.loads(text) if text and text.lstrip().startswith("{") else None
        if v and isinstance(v.get("tool_calls"), list):
            for pos, x in enumerate(v["tool_calls"]):
                a, name, wrong = x.get("arguments"), x.get("name"), []
                if not isinstance(a, dict):
                    wrong = ["arguments are no object"]
                elif name not in schemas:
                    wrong = ["unknown tool"]
                else:
                    for p, (kind, needed) in schemas[name].items():
                        if p not in a:
                            wrong += [f"missing {p}"] * needed
                        elif not isinstance(a[p], kinds[kind]) or isinstance(a[p], bool):
                            wrong.append(f"type of {p}")
                    wrong += [f"unknown {p}" for p in a if p not in schemas[name]]
                calls.append((conv, turn, pos, x.get("id"), name, a, sorted(wrong), x.get("after", [])))
        elif v and "tool_call_id" in v:
            results.append((conv, turn, v["tool_call_id"], dumps(v.get("content"))))
        elif role == "user":
            calls.append((conv, turn, 0, f"{conv}:{turn}", "reply", {"text": text}, [], []))
        elif role == "assistant":
            results.append((conv, turn, f"{conv}:{turn - 1}", dumps(text)))
        else:
            out.append((conv, turn, 0, "message", None, 0, "message", 0, dumps({"content": text, "id": None, "role": role})))
    ids = [c[3] for c in calls]
    needs: dict = {}
    for c in calls:
        needs.setdefault(c[3], set()).update(x for x in c[7] if x in ids)

    def level(i, above=()):
        if i in above:
            return -1
        below = [level(x, (*above, i)) for x in needs.get(i, ())]
        return -1 if -1 in below else max((b + 2 for b in below), default=0)

    for conv, turn, pos, i, name, a, wrong, _ in calls:
        own = sorted((t, c) for _, t, k, c in results if k == i)
        lv = level(i) if i is not None else 0
        status = "cyclic" if lv < 0 else "ambiguous" if ids.count(i) > 1 else "invalid" if wrong else "linked" if own else "pending"
        body = {"arguments": a, "errors": wrong, "id": i, "level": lv, "name": name, "result": json.loads(own[0][1]) if own else None}
        out.append((conv, turn, pos, "call", i, lv, status, len(own), dumps(body)))
    out += [(conv, turn, 0, "result", i, 0, "orphan", 0, dumps({"content": json.loads(c), "id": i, "role": "result"})) for conv, turn, i, c in results if i not in ids]
    return sorted(out, key=str)


def test_random_conversations_against_brute_force(spark):
    import random

    rng = random.Random(6)
    schemas = {"add": {"a": ("number", True), "note": ("string", False)}, **tc.REPLY}
    for _ in range(3):
        rows, names = [], [f"k{i}" for i in range(25)]
        for conv in range(12):
            for turn in range(rng.randrange(1, 9)):
                r = rng.random()
                if r < 0.35:
                    some = []
                    for _ in range(rng.randrange(0, 4)):
                        arguments = {k: rng.choice([1, 2.5, "x", True]) for k in rng.sample(["a", "note", "z"], rng.randrange(0, 4))}
                        some.append({"id": rng.choice(names), "name": rng.choice(["add", "add", "odd"]), "arguments": rng.choice([arguments, arguments, "text"]), "after": rng.sample(names, rng.randrange(0, 2))})
                    rows.append((conv, turn, "assistant", json.dumps({"tool_calls": some})))
                elif r < 0.6:
                    rows.append((conv, turn, "tool", json.dumps({"tool_call_id": rng.choice(names), "content": rng.choice([1, "two", None, {"b": 1, "a": [1, 2]}])})))
                else:
                    rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), rng.choice(["plain", 'with "quotes"\n', ""])))
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
        assert sorted((tuple(r) for r in tc.link(df, schemas).collect()), key=str) == brute(rows, schemas)


def test_very_long_texts(spark):
    long = "word " * 300_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", json.dumps({"tool_calls": [call("x", a=1, b=2, note=long)]})), (1, 2, "tool", json.dumps({"tool_call_id": "x", "content": long}))]
    got = {r["call_id"]: r for r in tc.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), SCHEMAS).collect()}
    assert got["x"]["status"] == "linked" and json.loads(got["x"]["json"])["result"] == long and json.loads(got["1:0"]["json"])["arguments"]["text"] == long
