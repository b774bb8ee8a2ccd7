from plumbline.policy import AuditPolicy
from plumbline.sources import files, requests


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_blank_branch_becomes_default(spark):
    df = spark.createDataFrame([(1, "  "), (2, " main "), (3, None), (4, "\t\n")], "request_id int, branch string")
    assert rows(requests.default_branch(df)) == [(1, "develop"), (2, "main"), (3, "develop"), (4, "develop")]


def test_url_positions_count_from_the_end(spark):
    base = "https://git.example.com/projects/P/repos/R/browse"
    df = spark.createDataFrame(
        [(1, base), (2, base + "/"), (3, base + "/src"), (4, "ftp://x"), (5, "see " + base)],
        "request_id int, url string")
    assert rows(requests.parse_urls(df).drop("url"), "request_id") == [
        (1, True, "P", "R"), (2, True, "repos", "browse"), (3, True, "repos", "browse"),
        (4, False, None, ""), (5, False, "P", "R"),
    ]


def test_requests_without_url_or_token_are_rejected(spark):
    df = spark.createDataFrame(
        [(1, "u", True), (2, "", True), (3, None, False), (4, "u", None)],
        "request_id int, url string, has_token boolean")
    assert rows(requests.admit(df).drop("url"), "request_id") == [
        (1, True, None), (2, False, "no url"), (3, False, "no url and token"), (4, False, "no token"),
    ]


def test_missing_files_read_as_empty(make_files):
    rf = make_files({"R": {"setup.py": "x", "R/app.py": "", "other.py": "y"}, "S": {"R/app.py": "not mine"}})
    found = {(r.repo, r.path): (r.content, r.is_missing) for r in files.content_lookup(rf).collect()}
    assert len(found) == 28
    assert found["R", "setup.py"] == ("x", False)
    assert found["R", "R/app.py"] == ("", False)
    assert found["S", "S/app.py"] == ("", True)
    assert files.expected_files_missing(rf).count() == 12 + 14


def test_content_lookup_shuffles_no_body(make_files):
    plan = files.content_lookup(make_files({"R": {"setup.py": "x"}}))._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and "content" not in " ".join(exchanges) and "Join" not in plan


def test_build_file_is_a_parameter(make_files):
    rf = make_files({"R": {"build.conf": ""}})
    assert ("R", "develop", "build.conf") not in rows(files.expected_files_missing(rf, AuditPolicy(build_file="build.conf")))


def test_checkouts_keep_path_order(spark, tmp_path):
    for path, text in {"r1/b.py": "b\n", "r1/a/x.py": "x", "r2/README.md": "hi"}.items():
        target = tmp_path / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    table = files.read_checkouts(spark, str(tmp_path))
    assert [(r.repo, r.path, r.content) for r in table.orderBy("repo", "file_ord").collect()] == [
        ("r1", "a/x.py", "x"), ("r1", "b.py", "b\n"), ("r2", "README.md", "hi"),
    ]


def test_file_table_round_trip(spark, make_files, tmp_path):
    make_files({"R": {"a.py": None, "b.py": "x"}}).write.parquet(str(tmp_path / "t"))
    table = files.read_file_table(spark, str(tmp_path / "t"))
    assert [r.content for r in table.orderBy("path").collect()] == ["", "x"]


def test_checkout_paths_are_decoded_and_the_root_is_literal(spark, tmp_path):
    root = tmp_path / "a+b (c) 1.0"
    for name in ("x y.py", "p+q.py", "r%20s.py", "sub dir/é.py"):
        target = root / "r1" / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(name)
    rows = files.read_checkouts(spark, str(root)).collect()
    assert sorted((r.repo, r.path, r.content) for r in rows) == sorted(("r1", n, n) for n in ("x y.py", "p+q.py", "r%20s.py", "sub dir/é.py"))


def test_more_expected_paths_than_bits_of_a_number(make_files):
    paths = tuple((f"f{i}.py", i % 2 == 1) for i in range(150))
    table = make_files({"R": {"f0.py": "", "R/f1.py": "", "f100.py": "", "R/f149.py": "", "f3.py": ""}})
    missing = {r.scope_pos for r in files.missing_paths(table, paths).collect()}
    assert missing == set(range(150)) - {0, 1, 100, 149}


def test_bodies_are_read_of_wanted_files_only(spark, make_files, tmp_path):
    from plumbline.operators import comments, config, constants, flags, naming

    make_files({"R": {"setup.py": "version='1'"}, "S": {"x.py": ""}}).write.parquet(str(tmp_path / "t"))
    table = files.read_file_table(spark, str(tmp_path / "t"))
    for rule in (config.sonar, config.conf_size, config.conf_schema, config.io_suffixes, config.min_version, config.repo_versions,
                 flags.app_logic, flags.flags_by_repo, constants.picked_fields, files.content_lookup):
        found = rule(table)
        plan = found._jdf.queryExecution().executedPlan().toString()
        scans = [line for line in plan.splitlines() if "FileScan" in line]
        with_body = [line for line in scans if "content:string" in line.split("ReadSchema")[1]]
        assert with_body and all("path" in line.split("PushedFilters")[1].split("ReadSchema")[0] for line in with_body), rule.__name__
        assert len(scans) > len(with_body), rule.__name__
        assert {r.repo for r in found.collect()} >= {"R", "S"}, rule.__name__
