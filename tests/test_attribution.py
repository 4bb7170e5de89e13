import pytest

from ledgerlink.model import ONLY_EMPTY, AttributionConfig, AttributionKey
from ledgerlink.operators.attribution import attribute, attribution_counts, write_back

COLS = ["k1", "k2", "nome", "valor"]
KEY_1 = AttributionKey("CHAVE_1", ["k1"], ["k1"])
KEY_2 = AttributionKey("CHAVE_2", ["k2"], ["k2"])


def run(table, origin, dest, **cfg):
    cfg = AttributionConfig(**{"keys": [KEY_1], "selected": ["nome"], **cfg})
    result = attribute(table(COLS, origin), table(COLS, dest), cfg)
    return {r["dest_row_id"]: r for r in result.collect()}, cfg, result


def test_overwrite_replaces_and_unmatched_rows_are_absent(table):
    got, _, _ = run(table, [("A", "", " NEW ", "1")], [("A", "q", "OLD", "2"), ("B", "", "OLD", "3")])
    assert set(got) == {0}
    assert (got[0]["nome"], got[0]["orig_row_id"], got[0]["matched_key"]) == ("NEW", 0, "CHAVE_1")
    assert got[0]["CHAVE_1"] == "A"


def test_only_empty_keeps_what_is_there(table):
    dest = [("A", "", v, "") for v in ["DEST", "", "0", "0.00", "null", None, "0.0", "  "]]
    got, _, _ = run(table, [("A", "", "NEW", "")], dest, mode=ONLY_EMPTY)
    assert [got[i]["nome"] for i in range(8)] == ["DEST", "NEW", "NEW", "NEW", "NEW", "NEW", "0.0", "NEW"]


def test_empty_and_missing_origin_values(table):
    got, _, _ = run(table, [("A", "", "0.00", "")], [("A", "", "x", "")], selected=["nome", "cidade"])
    assert (got[0]["nome"], got[0]["cidade"]) == ("NULL", "NULL")
    got, _, _ = run(
        table, [("A", "", "", "")], [("A", "", "x", "")], selected=["nome", "cidade"], mode=ONLY_EMPTY
    )
    assert (got[0]["nome"], got[0]["cidade"]) == ("x", "NULL")


def test_first_key_and_lowest_origin_row_win(table):
    origin = [("x", "M", "by2", ""), ("A", "z", "first", ""), ("A", "z", "second", "")]
    dest = [("A", "M", "", ""), ("n", "M", "", ""), ("n", "n", "", "")]
    got, cfg, result = run(table, origin, dest, keys=[KEY_1, KEY_2])
    assert {i: (r["nome"], r["matched_key"]) for i, r in got.items()} == {
        0: ("first", "CHAVE_1"), 1: ("by2", "CHAVE_2"),
    }
    assert (got[1]["CHAVE_1"], got[1]["CHAVE_2"]) == ("n", "M")
    counts = attribution_counts(result, cfg).collect()
    assert [tuple(r) for r in counts] == [("CHAVE_1", 1), ("CHAVE_2", 1)]


def test_raw_keys_null_never_matches_blank_does(table):
    origin = [(None, "", "n", ""), ("", "", "blank", ""), (" A", "", "spaced", "")]
    dest = [(None, "", "", ""), ("", "", "", ""), ("A", "", "", ""), ("null", "", "", "")]
    got, _, _ = run(table, origin, dest)
    assert {i: r["nome"] for i, r in got.items()} == {1: "blank"}
    cleaned, _, _ = run(table, origin, dest, clean_keys=True)
    assert {i: r["nome"] for i, r in cleaned.items()} == {0: "n", 1: "n", 2: "spaced", 3: "n"}


def test_column_lists_pair_up_to_the_shorter(table):
    key = AttributionKey("CHAVE_1", ["k1", "k2"], ["k1"])
    got, _, _ = run(table, [("A", "other", "v", "")], [("A", "B", "", "")], keys=[key])
    assert got[0]["nome"] == "v"
    skipped = AttributionKey("CHAVE_9", [], ["k1"])
    got, cfg, result = run(table, [("A", "", "v", "")], [("A", "", "", "")], keys=[skipped, KEY_1])
    assert got[0]["matched_key"] == "CHAVE_1"
    assert [r["matched_key"] for r in attribution_counts(result, cfg).collect()] == ["CHAVE_1"]


def test_write_back_replaces_and_adds(table):
    origin = table(["k1", "nome", "cidade", "id"], [("A", "NEW", "SP", "9")])
    dest = table(["k1", "nome", "id"], [("A", "OLD", "1"), ("B", "KEEP", "2")])
    cfg = AttributionConfig([KEY_1], ["nome", "cidade", "id"])
    got = write_back(origin, dest, cfg)
    assert got.columns == ["row_id", "k1", "nome", "id", "cidade"]
    assert sorted(tuple(r) for r in got.collect()) == [(0, "A", "NEW", "1", "SP"), (1, "B", "KEEP", "2", None)]


def test_configuration_is_checked():
    ok = {"keys": [KEY_1], "selected": ["nome"]}
    AttributionConfig(**ok, origin=("a", "FISCAL"), dest=("b", "CONTABIL"))
    for bad in (
        {"mode": "APPEND"},
        {"keys": []},
        {"origin": ("a", "FISCAL"), "dest": ("a", "CONTABIL")},
        {"origin": ("a", "FISCAL"), "dest": ("b", "FISCAL")},
        {"origin": ("a", "FISCAL")},
    ):
        with pytest.raises(ValueError):
            AttributionConfig(**{**ok, **bad})
