"""Row rules, masks, group checks and routing on small hand-made tables and on the given ones."""

import pytest

from gristmill.functions.rules import dnf, mask, mask_pattern, rule, rule_failure_counts, with_failure_reason
from gristmill.operators.checks import group_verdict
from gristmill.operators.routing import control, extract_key, key_samples, key_scan, legacy_condition, outputs_of, route, route_counts, split_by, with_flag

DIR = "/root/testdata/sf0.001"


def picked(df, test, name, **how):
    """Values of a column in the rows that a rule picks."""
    return [r[0] for r in df.where(rule(df, test, **how)).select(name).orderBy(name).collect()]


def any_of(*rules):
    return {"groups": [{"rules": [r]} for r in rules]}


@pytest.fixture(scope="module")
def ships(spark):
    """Invented harbour entries: a hull code, the berth, and tons as text."""
    rows = [("NO-7741-K", "north", "120"), ("NO-88-K", "north", "95,5"), ("SE-1203-T", "south", "n/a"), ("dk-4410-t", "south", ""), ("FI-0009-Z", None, None)]
    return spark.createDataFrame(rows, "hull string, berth string, tons string")


# --- rules -------------------------------------------------------------------------


def test_several_values_are_any_or_none(ships):
    assert picked(ships, {"column": "hull", "test": "starts_with", "values": ["no", "  ", None, "fi"]}, "hull") == ["FI-0009-Z", "NO-7741-K", "NO-88-K"]
    assert picked(ships, {"column": "hull", "test": "not_contains", "values": ["-k", "-T"]}, "hull") == ["FI-0009-Z"]
    assert picked(ships, {"column": "hull", "test": "not_contains", "values": ["-k", "-T"]}, "hull", case_sensitive=True) == ["FI-0009-Z", "NO-7741-K", "NO-88-K", "dk-4410-t"]
    assert picked(ships, {"column": "berth", "test": "not_equals", "values": ["north"], "negate": True}, "hull") == ["NO-7741-K", "NO-88-K"]
    # nothing but blanks falls back to the single value
    assert picked(ships, {"column": "hull", "test": "equals", "values": ["", " "], "value": "DK-4410-T"}, "hull") == ["dk-4410-t"]


@pytest.mark.parametrize("test", ["equals", "not_equals", "contains", "not_contains", "num_ne", "is_empty", "not_empty"])
@pytest.mark.parametrize("negate", [False, True])
@pytest.mark.parametrize("more", [{"value": "x"}, {"values": ["x", "y"]}, {"via": "column", "column2": "hull"}])
def test_a_rule_on_an_unknown_column_matches_nothing(ships, test, negate, more):
    assert picked(ships, {"column": "draught", "test": test, "negate": negate, **more}, "hull") == []


def test_an_unknown_second_column_matches_nothing(ships):
    assert picked(ships, {"column": "hull", "test": "not_equals", "via": "column", "column2": "draught", "values": ["x"]}, "hull") == []
    with pytest.raises(ValueError):
        rule(ships, {"column": "hull", "test": "rhymes_with", "value": "x"})


def test_nulls_blanks_and_unreadable_numbers(ships):
    assert len(picked(ships, {"column": "tons", "test": "is_empty"}, "hull")) == 2
    assert len(picked(ships, {"column": "berth", "test": "not_equals", "value": "east"}, "hull")) == 5
    assert picked(ships, {"column": "tons", "test": "num_ge", "value": "100"}, "hull") == ["NO-7741-K"]
    assert picked(ships, {"column": "tons", "test": "num_ne", "value": 120}, "hull") == []
    assert len(picked(ships, {"column": "tons", "test": "num_lt", "value": "a lot", "negate": True}, "hull")) == 5
    assert picked(ships, {"column": "tons", "test": "is_numeric"}, "tons") == ["120", "95,5"]
    assert picked(ships, {"column": "tons", "test": "length_min", "value": "many"}, "hull") == []
    assert ships.where(dnf(ships, {"groups": [{"rules": []}, {}]})).count() == 0


def test_numbers_as_text_and_patterns(spark):
    df = spark.createDataFrame([(2.5e7, "tail\n"), (None, "tail"), (4.0, "head(")], "n double, s string")
    assert picked(df, {"column": "n", "test": "equals", "value": "25000000.0"}, "n") == [2.5e7]
    assert picked(df, {"column": "n", "test": "num_ne", "value": 4}, "n") == [2.5e7]
    assert picked(df, {"column": "s", "test": "regex_full", "value": "tail"}, "s") == ["tail"]
    assert picked(df, {"column": "s", "test": "regex", "value": "head("}, "s") == []
    with pytest.raises(ValueError):
        rule(df, {"column": "s", "test": "regex", "value": "(?P<part>l)"})


def test_numeric_rules_reach_the_scan(spark):
    """A numeric rule, and a preview filter, are pushed into the Parquet reader."""
    from gristmill.operators.profiling import preview

    parts = spark.read.parquet(f"{DIR}/part.parquet")
    both = {"groups": [{"rules": [{"column": "p_retailprice", "test": "num_gt", "value": 1000}, {"column": "p_size", "test": "num_le", "value": 7}]}]}
    for rows in (parts.where(dnf(parts, both)), preview(parts, [{"column": "p_size", "op": "equals", "value": "7"}])[0]):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert "p_size" in pushed


def test_positions_and_unicode_classes(spark):
    df = spark.createDataFrame([("Ørn5",), ("ørn5",), ("5Ørn",)], "s string")
    first_upper = {"column": "s", "test": "char_class", "position": 1, "charclass": "upper"}
    assert picked(df, first_upper, "s", case_sensitive=True) == ["Ørn5"]
    assert picked(df, first_upper, "s") == ["Ørn5", "ørn5"]
    assert len(picked(df, {"column": "s", "test": "substr_class", "start": 2, "length": 3, "charclass": "alnum"}, "s")) == 3
    assert picked(df, {"column": "s", "test": "substr_class", "start": 2, "length": 9, "charclass": "alnum"}, "s") == []
    assert picked(df, {"column": "s", "test": "substr_equals", "start": 2, "value": "RN5"}, "s") == ["Ørn5", "ørn5"]


# --- masks -------------------------------------------------------------------------

HULL = [{"type": "upper", "length": 2}, {"type": "literal", "value": "-"}, {"type": "digit", "min": 2, "max": 4}, {"type": "literal", "value": "-"}, {"type": "set", "value": "KT"}]


def test_masks(ships):
    masked = lambda segments, *case: [r[0] for r in ships.where(mask(ships, "hull", segments, *case)).select("hull").orderBy("hull").collect()]
    assert masked(HULL) == ["NO-7741-K", "NO-88-K", "SE-1203-T", "dk-4410-t"]
    assert masked(HULL, True) == ["NO-7741-K", "NO-88-K", "SE-1203-T"]
    assert masked([{"type": "any", "min": 1}]) == sorted(["NO-7741-K", "NO-88-K", "SE-1203-T", "dk-4410-t", "FI-0009-Z"])
    assert masked([{"type": "alnum", "length": 2}]) == [] and masked([{"type": "set", "value": ""}]) == []
    assert ships.where(mask(ships, "berth", [])).count() == 1
    assert ships.where(mask(ships, "draught", [])).count() == 0


def test_mask_signs_stand_for_themselves(spark):
    df = spark.createDataFrame([("[^]\\E-.",), ("x^]\\E-.",)], "s string")
    exact = [{"type": "set", "value": "[]^-\\"}, {"type": "literal", "value": "^]\\E-."}]
    assert [r[0] for r in df.where(mask(df, "s", exact)).collect()] == ["[^]\\E-."]
    assert mask_pattern([{"type": "digit", "length": 3}, {"type": "lower"}]) == "[0-9]{3}[a-z]"


def test_failure_reasons(ships):
    spec = {"groups": [{"rules": [{"column": "hull", "test": "starts_with", "value": "NO", "label": "flag"}, {"column": "tons", "test": "num_lt", "value": 110, "label": "light"}]}]}
    got = {r["hull"]: (r["motif"], r["failed_rules"]) for r in with_failure_reason(ships, spec).collect()}
    assert got["NO-7741-K"] == ("light", ["light"]) and got["SE-1203-T"] == ("flag", ["flag", "light"])
    assert {r["label"]: r["failed"] for r in rule_failure_counts(ships, spec).collect()} == {"flag": 3, "light": 5}
    blocked = {r["hull"]: r["motif"] for r in with_failure_reason(ships, {"kind": "mask", "column": "hull", "segments": HULL}, True).collect()}
    assert blocked["NO-88-K"] is None and blocked["dk-4410-t"] == "segment 1: upper" and blocked["FI-0009-Z"] == "segment 5: set KT"


# --- routing -----------------------------------------------------------------------


def tally(routed):
    return {r["route"]: r["rows"] for r in route_counts(routed).collect()}


def test_routes(ships):
    north, k = any_of({"column": "berth", "test": "equals", "value": "north"}), any_of({"column": "hull", "test": "ends_with", "value": "t"}, {"column": "hull", "test": "contains", "value": "7741"})
    outs = [{"id": "n", "match": north}, {"id": "k", "match": k}]
    assert tally(route(ships, outs)) == {"n": 2, "k": 2, "else": 1}
    assert tally(route(ships, outs, mode="all")) == {"n": 2, "k": 3, "else": 1}
    turned = route(ships, [{"id": "rest", "match": north | {"negate": True}}], else_output=False)
    assert tally(turned) == {"rest": 3, None: 2} and outputs_of(turned, ["rest"])["rest"].count() == 3


def test_named_conditions_and_controls(ships):
    named = [{"id": 4, **any_of({"column": "tons", "test": "is_numeric"})}]
    assert tally(route(ships, [{"id": "weighed", "match": {"condition": 4}}], named)) == {"weighed": 2, "else": 3}
    sides = control(ships, named[0])
    assert (sides["valid"].count(), sides["invalid"].count()) == (2, 3)
    assert with_flag(ships, named[0]).where("valide = 'non'").count() == 3
    with pytest.raises(ValueError):
        route(ships, [{"id": "x", "match": {"condition": 5}}], named)
    by_mask = legacy_condition({"mode": "mask", "column": "hull", "segments": HULL})
    assert control(ships, by_mask)["valid"].count() == 4


# --- group checks ------------------------------------------------------------------


def verdicts(df, key, *checks, **how):
    return {r[key]: r["verdict"] for r in group_verdict(df, [key], checks, **how).collect()}


@pytest.fixture(scope="module")
def crews(spark):
    """Invented crew lists: three ships, one of them without ranks."""
    rows = [("Aino", "mate", "red"), ("Aino", "mate", "red"), ("Aino", None, "red"), ("Brage", "cook", "red"), ("Brage", "mate", "blue"), ("Cora", None, "blue"), ("Cora", None, None)]
    return spark.createDataFrame(rows, "ship string, rank string, watch string")


def test_group_nulls_and_distinct_values(crews):
    assert verdicts(crews, "ship", {"check": "not_all_null", "column": "rank"}, {"check": "unique", "column": "rank"}) == {"Aino": False, "Brage": True, "Cora": False}
    assert verdicts(crews, "ship", {"check": "all_null", "column": "rank"}) == {"Aino": False, "Brage": False, "Cora": True}
    assert verdicts(crews, "ship", {"check": "constant", "column": "watch"}) == {"Aino": True, "Brage": False, "Cora": False}
    assert verdicts(crews, "ship", {"check": "constant", "column": "rank"}) == {"Aino": False, "Brage": False, "Cora": True}
    assert verdicts(crews, "ship", {"check": "distinct_max", "column": "rank", "n": 1}) == {"Aino": False, "Brage": False, "Cora": True}
    for bad in ([{"check": "size_max"}], [{"check": "unique", "column": "absent"}]):
        with pytest.raises(ValueError):
            group_verdict(crews, ["ship"], bad)
    with pytest.raises(ValueError):
        group_verdict(crews, ["port"], [{"check": "size_eq", "n": 1}])


def test_group_case_and_null_keys(spark):
    df = spark.createDataFrame([("x", "Open"), ("X", "shut"), ("y", "OPEN"), (None, "shut"), (None, "shut")], "g string, state string")
    shut = {"check": "contains", "column": "state", "value": "Shut"}
    assert verdicts(df, "g", shut) == {"x": True, "X": True, "y": False, None: True}
    assert verdicts(df, "g", shut, case_sensitive=True) == {"x": False, "X": False, "y": False, None: False}
    assert verdicts(df, "g", {"check": "size_eq", "n": 2})[None] is True


def test_group_dependencies(crews):
    holds = lambda check, **more: verdicts(crews, "ship", {"check": check, "column": "rank", "column2": "watch", **more})
    assert holds("determines") == {"Aino": True, "Brage": True, "Cora": False}
    assert verdicts(crews, "ship", {"check": "determines", "column": "watch", "column2": "rank"}) == {"Aino": False, "Brage": True, "Cora": True}
    assert holds("distinct_cmp", op="gt") == {"Aino": True, "Brage": False, "Cora": False}


def test_group_premises(crews):
    red = any_of({"column": "watch", "test": "equals", "value": "red"})
    ranked = any_of({"column": "rank", "test": "not_empty"})
    assert verdicts(crews, "ship", {"check": "rows_satisfy", "when": red, "then": ranked}) == {"Aino": False, "Brage": True, "Cora": True}
    assert verdicts(crews, "ship", {"check": "size_min", "n": 2, "when": red}) == {"Aino": True, "Brage": False, "Cora": True}
    whole = group_verdict(crews, [], [{"check": "size_eq", "n": 7}])
    assert {r["verdict"] for r in whole.collect()} == {True}


# --- keys --------------------------------------------------------------------------


@pytest.mark.parametrize(
    "extractor, exact, values, keys",
    [
        ({"type": "after_last", "sep": "-"}, False, ["NO-88-K", "plain", None, "a-"], ["k", "", "", ""]),
        ({"type": "before_first", "sep": "-"}, False, ["NO-88-K", "plain", None], ["no", "plain", ""]),
        ({"type": "segment", "sep": "::", "index": -2}, True, ["q::R::s", "one", ""], ["R", "", ""]),
        ({"type": "segment", "sep": ".", "index": 2}, True, ["q.R.s", "one"], ["R", ""]),
        ({"type": "substring", "start": 3, "length": 2}, False, ["ABCDE", "AB", None], ["cd", "", ""]),
        ({"type": "regex", "pattern": "-([0-9]+)-"}, False, ["NO-88-K", "none"], ["88", ""]),
        ({"type": "regex", "pattern": "[A-Z]{2}"}, True, ["xNOx"], ["NO"]),
        ({"type": "regex", "pattern": "["}, True, ["xNOx"], [""]),
    ],
)
def test_key_extractors(spark, extractor, exact, values, keys):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    assert [r[0] for r in df.orderBy("i").select(extract_key(df, "v", extractor, exact)).collect()] == keys


@pytest.mark.parametrize("extractor", [{"type": "segment", "index": 0}, {"type": "segment", "index": "x"}, {"type": "substring", "start": -1}, {"type": "substring", "length": 0}, {"type": "nothing"}])
def test_unusable_extractors_are_errors(spark, extractor):
    with pytest.raises(ValueError):
        extract_key(spark.createDataFrame([("a",)], "v string"), "v", extractor)


def test_split_and_scan(ships):
    last = {"type": "after_last", "sep": "-"}
    assert tally(split_by(ships, "hull", last, ["K", "t"])) == {"K": 2, "t": 2, "else": 1}
    assert [(r["key"], r["rows"], r["n_keys"], r["truncated"]) for r in key_scan(ships, "hull", last, cap=2).collect()] == [("k", 2, 3, True), ("t", 2, 3, True)]
    assert key_samples(ships, "hull", last, n=3).count() == 3
