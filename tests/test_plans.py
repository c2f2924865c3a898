"""Plan-shape checks for the properties that matter at scale.

The physical plan text is parsed into a tree (AQE off, so the plan is final
before execution).
"""

import os
import re

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


class Node:
    def __init__(self, text, depth):
        self.text, self.depth, self.children = text, depth, []

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()


def plan_tree(df) -> Node:
    text = df._jdf.queryExecution().executedPlan().treeString()
    root, stack = None, []
    for line in text.splitlines():
        if not line.strip():
            continue
        m = re.search(r"[+:]- ", line)
        depth = (m.start() // 3 + 1) if m else 0
        body = line[m.end():] if m else line.strip()
        node = Node(re.sub(r"^\*\(\d+\)\s*", "", body.strip()), depth)  # drop codegen stage ids
        while stack and stack[-1].depth >= depth:
            stack.pop()
        if stack:
            stack[-1].children.append(node)
        else:
            root = node
        stack.append(node)
    return root


@pytest.fixture
def no_aqe(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def _first_exchange_below(node):
    for child in node.children:
        for n in child.walk():
            if "Exchange" in n.text.split(" ")[0] or n.text.startswith("Exchange"):
                return n
    return None


@pytest.mark.parametrize("name", ["FISH", "ZOO", "DRAFT_FISH"])
def test_windows_only_over_the_small_annual_table(no_aqe, name):
    from driftline.plans import catalog
    from driftline.plans.survey import analyse
    from driftline.sources.fixture import tow_view
    tree = plan_tree(analyse(tow_view(no_aqe, SF), getattr(catalog, name))._stats)
    windows = [n for n in tree.walk() if n.text.startswith("Window")]
    assert windows, "expected running-mean windows"
    for w in windows:  # an aggregate stands between the windows and any scan
        chain = w
        while not chain.text.startswith("HashAggregate"):
            assert "FileScan" not in chain.text and "Join" not in chain.text.split(" ")[0]
            chain = chain.children[0]


def test_an_absurd_year_does_not_shuffle_tows(no_aqe, tows):
    from driftline.plans.survey import analyse, maintained_volume
    rows = [dict(region=3, month=7, year=y, volume_1m2=1.0 + y % 7) for y in [*range(1980, 2010)] * 6 + [20_000_000]]
    s = analyse(tows(rows), maintained_volume())
    for df in (s.tows(), s.with_annual_mean(), s.final()):
        ops = [n.text.split(" ")[0] for n in plan_tree(df).walk()]
        assert "SortMergeJoin" not in ops and "BroadcastHashJoin" in ops
    assert s.tows().count() == len(rows) and s.final().count() == 31


def _scanned(tree, table):
    scans = [n.text for n in tree.walk() if "FileScan" in n.text and f"{table}.parquet" in n.text]
    return [len(re.search(r"FileScan parquet \[([^\]]*)\]", s).group(1).split(",")) for s in scans]


def test_the_stored_pass_reads_only_what_a_report_needs(no_aqe):
    from driftline.plans.catalog import FISH, ZOO
    from driftline.plans.survey import Record
    from driftline.sources.fixture import tow_view
    volume = Record(tow_view(no_aqe, SF), ZOO).narrow()
    assert volume.columns == ["region_name", "season", "year", "volume_1m2"]
    assert _scanned(plan_tree(volume), "lineitem") == [3]
    assert _scanned(plan_tree(volume), "orders") == [3]
    fish = Record(tow_view(no_aqe, SF), FISH).narrow()
    assert fish.columns == ["region_name", "season", "year", "fishsum"]


def test_first_rows_are_picked_without_their_payload(no_aqe):
    from driftline.plans.catalog import FISH, ZOO
    from driftline.plans.survey import analyse
    from driftline.sources.fixture import tow_view
    for spec in (FISH, ZOO):
        s = analyse(tow_view(no_aqe, SF), spec)
        for df in (s.final(), s.first_rows()):
            for n in plan_tree(df).walk():
                # only the few fetched rows are aggregated; nothing is picked by min_by
                assert "min_by" not in n.text, n.text[:200]


@pytest.mark.parametrize("name,columns", [("q_taxon_series", 1), ("q_fourth_root", 1), ("q_isin", 2), ("q_taxa_all", 4)])
def test_only_wanted_taxa_are_expanded(no_aqe, name, columns):
    from driftline.plans.catalog import QUERIES
    tree = plan_tree(QUERIES[name](no_aqe, SF))
    expands = [n.text for n in tree.walk() if n.text.startswith("Expand")]
    assert sum(t.count("_10m2,") for t in expands) == columns or columns == 1 and not expands


def test_fixture_fact_joins_are_sort_merge(no_aqe):
    from driftline.sources.fixture import tow_view
    tree = plan_tree(tow_view(no_aqe, SF))
    joins = [n.text.split(" ")[0] for n in tree.walk() if "Join" in n.text.split(" ")[0]]
    assert joins.count("SortMergeJoin") == 2
    for n in tree.walk():
        if n.text.startswith("BroadcastExchange"):
            scans = [m.text for m in n.walk() if "FileScan" in m.text]
            assert all("lineitem" not in s and "orders" not in s for s in scans)


def test_annual_scan_reads_only_needed_columns(no_aqe):
    from driftline.plans.catalog import QUERIES
    tree = plan_tree(QUERIES["q_run_mean"](no_aqe, SF))
    scans = [n.text for n in tree.walk() if "FileScan" in n.text]
    assert scans
    for s in scans:
        cols = re.search(r"FileScan parquet \[([^\]]*)\]", s).group(1).split(",")
        assert len(cols) <= 4, s[:120]


def test_dedupe_is_an_aggregate_not_a_window(no_aqe):
    from driftline.plans.catalog import FISH
    from driftline.plans.survey import prepared
    from driftline.sources.fixture import tow_view
    tree = plan_tree(prepared(tow_view(no_aqe, SF), FISH))
    names = [n.text.split(" ")[0].split("(")[0] for n in tree.walk()]
    assert not any(x.startswith("Window") for x in names)
    assert any("Aggregate" in x for x in names)


@pytest.mark.parametrize("name", ["q_zoo_full", "q_sd_weighted", "q_group_broadcast"])
def test_tow_level_outputs_do_not_shuffle_tows(no_aqe, name):
    from driftline.plans.catalog import QUERIES
    tree = plan_tree(QUERIES[name](no_aqe, SF))
    joins = [n for n in tree.walk() if n.text.split(" ")[0] in ("SortMergeJoin", "ShuffledHashJoin")]
    # the two fact joins of the fixture view; a deduped analysis has stored what comes out of them
    assert len(joins) == (0 if name == "q_sd_weighted" else 2)
    inputs = {id(m) for j in joins for m in j.walk()}
    for n in tree.walk():  # beyond those, an exchange only takes what a partial aggregate left
        if n.text.startswith("Exchange") and id(n) not in inputs:
            assert "Aggregate" in n.children[0].text.split("(")[0], n.text[:100]
    assert "BroadcastHashJoin" in [n.text.split(" ")[0] for n in tree.walk()]


@pytest.mark.parametrize("name", ["q_fish_full", "q_run_mean_final", "q_distinct_first"])
def test_first_rows_are_fetched_below_the_fact_joins(no_aqe, name):
    from driftline.plans.catalog import QUERIES
    tree = plan_tree(QUERIES[name](no_aqe, SF))
    for table in ("lineitem", "orders"):
        scans = [n for n in tree.walk() if "FileScan" in n.text and f"{table}.parquet" in n.text]
        assert len(scans) == 1
        semi = [n for n in tree.walk() if n.text.startswith("BroadcastHashJoin") and "LeftSemi" in n.text and scans[0] in list(n.walk())]
        assert semi, f"{table} is not filtered by the keys"
        below = list(semi[-1].walk())
        between = [n for n in below if n.text.startswith("Exchange") and scans[0] in list(n.walk())]
        assert not between, f"{table} is shuffled before it is filtered"


def test_a_deduped_output_dedupes_once(no_aqe):
    from driftline.plans.catalog import FISH
    from driftline.plans.survey import analyse
    from driftline.sources.fixture import tow_view
    s = analyse(tow_view(no_aqe, SF), FISH)
    tree = plan_tree(s.tows())
    assert not any("min_by" in n.text or "lineitem.parquet" in n.text for n in tree.walk())
    assert len(s.record._paths) == 2  # the rows and the annual statistics


def test_stored_forms_read_only_their_folders(no_aqe):
    from driftline.plans.catalog import QUERIES
    taxa = [n.text for n in plan_tree(QUERIES["q_taxa_split"](no_aqe, SF)).walk() if "FileScan" in n.text]
    assert len(taxa) == 1 and re.search(r"PartitionFilters: \[[^\]]*taxa", taxa[0])
    early = [n.text for n in plan_tree(QUERIES["q_period_stored"](no_aqe, SF)).walk() if "FileScan" in n.text]
    pruned = [t for t in early if re.search(r"PartitionFilters: \[[^\]]*year", t)]
    assert len(early) == 2 and len(pruned) == 1  # the minimum reads one column of the whole record


def test_rare_repeats_are_exchanged_alone(no_aqe):
    from driftline.operators.dedupe import prefer_where_repeated
    from pyspark.sql import functions as F
    df = no_aqe.range(1000).select((F.col("id") % 997).alias("k"), F.lit("g").alias("gear"), "id")
    tree = plan_tree(prefer_where_repeated(df, ["k"], "gear", "x", [F.col("id")]))
    for n in tree.walk():
        if n.text.startswith("Exchange"):  # only what has met the stored hashes, or is a key table
            assert any("LeftSemi" in m.text for m in n.walk()), n.text[:100]
