"""Query-level tests of sources, sinks and checks on a small table folder."""

import pytest

from shelfcast.plans import check_queries, panel_queries

SF = "/root/testdata/sf0.001"


def verdicts(spark, name):
    return {r["input"]: r.verdict for r in panel_queries.QUERIES[name](spark, SF).collect()}


@pytest.mark.parametrize("name", ["v3_context_check", "v5_oil_check", "v6_traffic_check", "v10_forecast_panel_check", "v12_submission_check", "v14_bucket_cover"])
def test_check_passes_whole_tables_and_names_each_fault(spark, name):
    said = verdicts(spark, name)
    # 840 test rows, four quantiles each
    assert said.pop("whole") == ("3360 rows covered" if name == "v14_bucket_cover" else "ok")
    assert said and "ok" not in said.values()


def test_every_query_of_the_module_has_sql():
    names = [n for n, f in vars(check_queries).items() if n[0] in "sfpajvc" and n[1:2].isdigit() and callable(f)]
    assert len(names) == 28
    assert all(n in panel_queries.QUERIES and n in panel_queries.SQL for n in names)


def test_folder_without_a_file_is_named(spark, tmp_path):
    from shelfcast.sources import files

    with pytest.raises(FileNotFoundError, match="oil_prices.csv"):
        files.scan_sources(spark, str(tmp_path))


def test_a_strict_day_is_refused_when_it_does_not_exist(spark):
    from shelfcast.sources import files

    with pytest.raises(Exception, match="(?i)date|parse"):
        spark.createDataFrame([("2026-13-01",)], "date string").select(files.parse_date()).collect()


def test_fingerprint_sees_every_code_file_of_one_name(tmp_path):
    from shelfcast.plans.cache import fingerprint

    code = []
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "__init__.py").write_text(folder)
        code.append(str(tmp_path / folder / "__init__.py"))
    before = fingerprint("stage", [], code, {})
    assert before == fingerprint("stage", [], code[::-1], {})
    for path in code:
        kept = open(path).read()
        open(path, "w").write("changed")
        assert fingerprint("stage", [], code, {}) != before
        open(path, "w").write(kept)
    assert fingerprint("stage", [], [], {}) == fingerprint("stage", [], [], {})
