import json

from trackscope.operators import nested

A = {"name": "a", "status": "seen", "confidence": "High", "evidence": None}


def positions(payload, kind="attribute"):
    return [(n["list_name"], n["pos"], n["name"]) for n in nested.record_nodes(payload) if n["node_type"] == kind]


def wrap(value):
    return json.dumps({"extracted_appearance_attributes": value})


def test_shapes_of_a_list():
    inner = "appearance_attributes"
    want = [("extracted_appearance", 0, "a"), ("extracted_appearance", 2, None)]
    elements = [A, None, A | {"name": None}]
    for value in ({inner: elements}, elements, {inner: [json.dumps(e) if e else e for e in elements]}, json.dumps({inner: elements})):
        assert positions(wrap(value)) == want
    assert positions(json.dumps(wrap({inner: elements}))) == want
    assert positions("```json\n" + wrap({inner: elements}) + "\n```") == want
    assert positions("Here is the record:\n" + wrap({inner: elements})) == want
    assert positions(wrap({inner: A})) == [("extracted_appearance", 0, "a")]


def test_objects_keep_repeated_names_in_order():
    text = '{"extracted_behavior_attributes": {"behavior_attributes": {"x": {"status": "1"}, "y": null, "x": {"status": "2"}}}}'
    assert positions(text) == [("extracted_behavior", 0, "x"), ("extracted_behavior", 2, "x")]


def test_nothing_and_broken_text():
    for text in (None, "", "no json", "{", "[1, 2", '"just text"', "null", wrap(None), wrap([]), wrap({}), wrap("text")):
        nodes = nested.record_nodes(text)
        assert nodes[0]["node_type"] == "record" and not positions(text)
        assert (nodes[0]["pre"], nodes[0]["post"]) == (0, 2 * len(nodes) - 1)


def test_trailing_commas_and_python_text():
    assert positions('{"extracted_appearance_attributes": [{"name": "a",},]}') == [("extracted_appearance", 0, "a")]
    assert positions("{'extracted_appearance_attributes': [{'name': 'a', 'status': None}]}") == [("extracted_appearance", 0, "a")]


def test_intervals_hold_exactly_the_descendants():
    payload = json.dumps({"validated_appearance_attributes": {"validated_appearance": [A | {"rubric scores": {"p": 1, "q": None}}, A], "quality_flags": ["f", None, "g"], "notes": "n"}})
    nodes = nested.record_nodes(payload)
    by_pre = {n["pre"]: n for n in nodes}
    for n in nodes:
        above = {m["pre"] for m in nodes if m["pre"] < n["pre"] and m["post"] > n["post"]}
        chain, at = set(), n
        while at["parent_pre"] is not None:
            at = by_pre[at["parent_pre"]]
            chain.add(at["pre"])
        assert above == chain and len(above) == n["depth"]
    assert positions(payload, "flag") == [("validated_appearance", 0, "f"), ("validated_appearance", 2, "g")]
    assert [n["score"] for n in nodes if n["node_type"] == "rubric"] == [1, None]


def test_columns_agree_with_their_own_text(spark, folder):
    from pyspark.sql import functions as F

    stage2 = spark.read.parquet(f"{folder}/stage2_cot.parquet").withColumn("pre", F.lit("clash")).withColumn("payload", F.lit(1))
    found = nested.found(stage2)
    assert found.count() == found.distinct().count()
    for list_name, outer, inner in nested.LISTS:
        exploded = stage2.select("record_id", F.posexplode(F.col(outer)[inner]).alias("pos", "a")).where("a IS NOT NULL").select("record_id", "pos").collect()
        ours = found.where((F.col("list_name") == list_name)).join(stage2.where("raw_json IS NULL").select("record_id"), "record_id").select("record_id", "pos").collect()
        assert sorted(map(tuple, exploded)) == sorted(map(tuple, ours))
    nodes = nested.nested_nodes(stage2)
    attributes, rubric = nested.attribute_table(nodes), nested.rubric_table(nodes)
    by_interval, by_parent = nested.under(attributes, rubric), nested.children_of(attributes, rubric)
    links = lambda df: sorted(map(tuple, df.select("record_id", "parent_pre", "pre").collect()))
    assert links(by_interval.drop("parent_pre").join(by_parent.select("record_id", "pre", "parent_pre"), ["record_id", "pre"])) == links(by_parent) and by_interval.count() == by_parent.count() == rubric.count()
    assert nested.nested_nodes(stage2.limit(0)).count() == 0


def test_columns_and_their_json_give_the_same_nodes(spark, folder):
    from pyspark.sql import functions as F

    stage2 = spark.read.parquet(f"{folder}/stage2_cot.parquet")
    outer = [name for _, name, _ in nested.LISTS]
    typed = stage2.where(F.greatest(*(F.col(c).isNotNull() for c in outer)))
    text = typed.select("record_id", F.to_json(F.struct(*outer), {"ignoreNullFields": "false"}).alias("raw_json"), *(F.lit(None).cast(typed.schema[c].dataType).alias(c) for c in outer))

    def links(df):
        """Every node without its numbers, with the node that it points to."""
        rows = [r.asDict() for r in nested.nested_nodes(df).collect()]
        plain = lambda r: tuple((k, v) for k, v in sorted(r.items()) if k not in ("pre", "post", "parent_pre"))
        by_pre = {(r["record_id"], r["pre"]): r for r in rows}
        assert len(by_pre) == len(rows) and all(r["pre"] < r["post"] for r in rows)
        for r in rows:
            if r["parent_pre"] is not None:
                above = by_pre[r["record_id"], r["parent_pre"]]
                assert above["pre"] < r["pre"] and r["post"] < above["post"] and above["depth"] + 1 == r["depth"]
        return sorted(((plain(r), r["parent_pre"] is not None and plain(by_pre[r["record_id"], r["parent_pre"]])) for r in rows), key=repr)

    assert links(typed) == links(text) and len(links(typed)) > 100


def test_wrappings_depth_and_strings(spark):
    payload = wrap([A])
    for _ in range(7):
        payload = json.dumps(payload)
        assert positions(payload) == [("extracted_appearance", 0, "a")]
    for text in ("[" * 200000, '{"a":' * 6000, "[" * 5000 + "]" * 5000, "{" * 3000 + "}" * 3000, '"' * 9999, "{'a" * 9999):
        assert not positions(text)
    assert nested.parse_text('{"e": "seen [1,] twice", "f": [1,],}') == [("e", "seen [1,] twice"), ("f", [1])]
    assert nested.parse_text('As "said" in [1], {see}: {"a": 1}') == [("a", 1)] and nested.parse_text("It's {'a': \"it's\", 'b': None}") == [("a", "it's"), ("b", None)]


def test_shred_labels_every_node(spark):
    kind = "id long, pre int, a array<struct<b: string, c: array<int>, d: struct<e: int, f: map<string,array<string>>>>>, s struct<x: int, t: array<array<int>>>"
    rows = [(1, 5, [("p", [1, None, 3], (7, {"k": ["u", None], "l": None})), None, (None, None, None)], (1, [[1], None, []])), (2, None, None, None), (3, None, [], (None, None))]
    tables = nested.shred(spark.createDataFrame(rows, kind), "id")
    assert list(tables) == ["record", "record.a", "record.a[]", "record.a[].c", "record.a[].c[]", "record.a[].d", "record.a[].d.f", "record.a[].d.f[]", "record.a[].d.f[].value", "record.a[].d.f[].value[]", "record.s", "record.s.t", "record.s.t[]", "record.s.t[][]"]
    got = {name: [r.asDict() for r in t.collect()] for name, t in tables.items()}
    nodes = [(r["id"], r["pre"], r["post"], r["parent_pre"], name) for name, rs in got.items() for r in rs]
    by_pre = {n[:2]: n for n in nodes}
    assert len(by_pre) == len(nodes)
    for n in nodes:
        above = [m for m in nodes if m[0] == n[0] and m[1] < n[1] and m[2] > n[2]]
        assert not any(m[0] == n[0] and m[1] < n[1] < m[2] < n[2] for m in nodes)
        nearest = max(above, key=lambda m: m[1], default=None)
        assert n[3] is None if nearest is None else n[3] == nearest[1] and n[4].startswith(nearest[4])
    assert [(r["pos"], r["b"]) for r in got["record.a[]"]] == [(0, "p"), (2, None)] and [(r["pos"], r["value"]) for r in got["record.a[].c[]"]] == [(0, 1), (2, 3)]
    assert {r["key"] for r in got["record.a[].d.f[]"]} == {"k", "l"} and {r["pos"] for r in got["record.a[].d.f[]"]} == {0, 1} and got["record"][0]["field_pre"] == 5
    assert {r["post"] for r in got["record"] if r["id"] == 2} == {1}
    assert nested.shred(spark.createDataFrame(rows, kind).limit(0), "id")["record.a[]"].count() == 0
