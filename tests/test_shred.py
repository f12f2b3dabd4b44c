import json

from hypothesis import given, settings
from hypothesis import strategies as st

from seedloom.operators.shred import INSTRUCTION_FILE, all_nodes, chains, flat_tables, nodes, rejects, shred_value


def walked(value):
    """The nodes by plain recursion."""
    out = set()

    def lists(v):
        return v if isinstance(v, list) else [] if v is None else [v]

    def down(at, level, parent):
        v = at
        for key in level.path:
            v = v.get(key) if isinstance(v, dict) else None
        for i, x in enumerate(lists(v)):
            if x is not None:
                path = f"{parent}.{level.code}{i}" if parent else f"{level.code}{i}"
                out.add((parent, path))
                for inner in level.inner:
                    down(x, inner, path)

    down(value, INSTRUCTION_FILE, "")
    return out


def read_back(value):
    out = set()
    for chain in chains(INSTRUCTION_FILE):
        reps, defs, _ = shred_value(value, chain, "", False)
        for at, _ in nodes(reps, defs, len(chain)):
            names = [f"{level.code}{k}" for level, k in zip(chain, at, strict=True)]
            out.add((".".join(names[:-1]), ".".join(names)))
    return out


example = st.recursive(
    st.fixed_dictionaries({}, optional={"Input": st.none() | st.text(max_size=3)}),
    lambda inner: st.fixed_dictionaries({}, optional={"Variants": st.none() | inner | st.lists(st.none() | inner, max_size=3), "Shuffles": st.none() | inner | st.lists(st.none() | inner, max_size=3)}),
    max_leaves=8,
)
some = lambda s: st.none() | s | st.lists(st.none() | s, max_size=3)
task = st.fixed_dictionaries({}, optional={"Instruction information": st.none() | st.fixed_dictionaries({}, optional={"Categories": some(st.text(max_size=2))}), "Definition": some(st.text(max_size=2)), "Positive Example": some(example), "Negative Example": some(example)})


@settings(max_examples=200, deadline=None)
@given(some(task))
def test_levels_round_trip(value):
    assert read_back(value) == walked(value)


def test_values_and_links(spark):
    doc = [{"Definition": "one", "Positive Example": [None, {"Input": "i", "Output": "o", "Variants": {"Input": "v", "Shuffles": [{"Input": "s"}, None, {"Output": "t"}]}}]}, None, "text"]
    rows = [(1, json.dumps(doc), "x"), (2, None, "x"), (3, "", "x"), (4, "{bad", "x"), (5, "null", "x"), (6, "[]", "x"), (7, json.dumps({"Definition": ["a" * 300_000, {"k": 1}]}), "x")]
    df = spark.createDataFrame(rows, "record_id long, raw_json string, parent_path string")
    tables = flat_tables(df, "record_id", "raw_json")
    assert [tuple(r) for r in tables["positive"].collect()] == [(1, "t0", "t0.p1", "i", "o", None)]
    assert [tuple(r) for r in tables["shuffle"].orderBy("node_path").collect()] == [(1, "t0.p1.v0", "t0.p1.v0.s0", "s", None, None), (1, "t0.p1.v0", "t0.p1.v0.s2", None, "t", None)]
    assert {(r["record_id"], r["node_path"]) for r in tables["task"].collect()} == {(1, "t0"), (1, "t2"), (7, "t0")}
    values = {r["node_path"]: r["value"] for r in tables["definition"].where("record_id = 7").collect()}
    assert len(values["t0.d0"]) == 300_000 and values["t0.d1"] == '{"k": 1}'
    deep = spark.createDataFrame([(8, "[" * 200_000, "x")], df.schema)
    why = {r["record_id"]: r["reason"] for r in rejects(df.union(deep), "record_id", "raw_json").collect()}
    assert why == {2: "no text", 3: "blank", 4: "no JSON", 8: why[8]} and why[8] in ("nested too deep", "no JSON")
    assert rejects(df.limit(0), "record_id", "raw_json").count() == 0
    assert all_nodes(df, "record_id", "raw_json").where("record_id in (2, 3, 4, 5, 6)").count() == 0
    assert all_nodes(df.limit(0), "record_id", "raw_json").count() == 0
    assert all_nodes(df.union(df), "record_id", "raw_json").count() == 2 * all_nodes(df, "record_id", "raw_json").count()
