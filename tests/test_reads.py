"""How often a report reads each input: counted in the plans of all it saves and of its result."""

from collections import Counter

import pytest

from adlytics.operators import identity
from adlytics.plans import reports
from adlytics.sources.derived import COUNTRY, CREATIVE_CHARACTERS, LOOKUP_DAY, MONTH, PIXELS, Derived
from adlytics.sources.tables import ParquetTables, save_table
from adlytics.workspace import Workspace
from checks import queries
from checks.queries import STORED_BY, stored_by_day

FOLDER = "/root/testdata/sf0.001"


def scans(frame, folder):
    """Scans of the tables below a folder, before exchanges are reused."""
    found = Counter()
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    for at in range(leaves.size()):
        leaf = leaves.apply(at)
        if leaf.getClass().getSimpleName() == "LogicalRelation":
            root = leaf.relation().location().rootPaths().head().toString()
            if f"{folder}/" in root:
                found[root.split(f"{folder}/")[1].split("/")[0]] += 1
    return found


class Watched(Workspace):
    """Counts what each saved table reads."""

    def __init__(self, spark, folder):
        super().__init__(spark)
        self.watched, self.reads = folder, Counter()

    def save(self, table, name):
        self.reads += scans(table, self.watched)
        return super().save(table, name)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stored"))
    derived = Derived(spark, FOLDER)
    stored_by_day(derived, folder)
    save_table(derived.line_items(), f"{folder}/line_items")
    for kind, rows in derived.id_mapping().items():
        save_table(rows, f"{folder}/id_mapping/{kind}")
    return ParquetTables(spark, folder, partitions=STORED_BY)


REPORTS = {
    "device_match": (lambda s, t: reports.device_match(s, t, PIXELS, MONTH), {"bidstream": 1, "site_events": 1}),
    "utm_conversions": (
        lambda s, t: reports.utm_conversions(s, t, PIXELS, MONTH, MONTH, LOOKUP_DAY, COUNTRY),
        {"bidstream": 1, "site_events": 1},
    ),
    "overlap": (lambda s, t: reports.overlap_report(s, t, PIXELS, MONTH, MONTH, COUNTRY, with_totals=True), {"bidstream": 1}),
    "placed_seats": (lambda s, t: reports.placed_seats(s, t, MONTH, MONTH, LOOKUP_DAY, COUNTRY)[0], {"bidstream": 1}),
    "cascade_people": (lambda s, t: reports.cascade_people(s, t, MONTH, MONTH, LOOKUP_DAY, COUNTRY), {"bidstream": 1}),
    "nested_root": (
        lambda s, t: reports.nested_root(s, t, MONTH, LOOKUP_DAY, CREATIVE_CHARACTERS),
        {"pages": 1, "win_log": 1, "site_sessions": 2},
    ),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reads(spark, tables, name):
    report, most = REPORTS[name]
    with Watched(spark, tables.folder) as space:
        result = report(space, tables)
        reads = space.reads + scans(result, tables.folder)
        assert {table: reads[table] for table in most} == most
        assert result.count() > 0


@pytest.mark.parametrize("name", ["attribute_conversions", "attributed_rows", "attributed_rows_in_slots", "conversion_lags", "campaign_rollup"])
def test_mapping_builds_each_side_of_the_root_once(spark, tables, name):
    """Neither is the root written to be read again, nor a side of it built twice."""
    saved = []

    class Named(Watched):
        def save(self, table, name):
            saved.append(name)
            return super().save(table, name)

    with Named(spark, "/root/testdata") as space:
        result = queries._REGISTERED[name](queries.Checked(spark, FOLDER, space))
        reads = space.reads + scans(result, "/root/testdata")
        assert "root" not in saved and saved.count("impressions") == 1
        # Of orders pages, wins and attention are derived; of events prefixes, tracker clicks and conversions.
        assert reads["sf0.001"] == 7
        assert result.count() > 0


def test_nested_root_saves_nothing_but_itself(spark, tables):
    saved = []

    class Named(Watched):
        def save(self, table, name):
            saved.append(name)
            return super().save(table, name)

    with Named(spark, tables.folder) as space:
        assert reports.nested_root(space, tables, MONTH, LOOKUP_DAY, CREATIVE_CHARACTERS).count() > 0
    assert saved == ["nested-root"]


def test_reach_builds_the_cached_households_once(spark, tables):
    """They are looked up for requests and again for the persons reached."""
    with Watched(spark, tables.folder) as space:
        placed, cached = reports.placed_seats(space, tables, MONTH, MONTH, LOOKUP_DAY, COUNTRY)
        result = identity.reach_report(placed, cached)
        reads = space.reads + scans(result, tables.folder)
        assert reads["id_mapping"] == 5 and reads["bidstream"] == 1
        assert result.count() > 0
