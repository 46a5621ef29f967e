"""Service maps, contracts, topology, deploy and CI change detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, normal_path
from ..functions.text import matches_any
from ..operators.joins import cross_service, longest_prefix

# Directory names by role: fixed values, in order of priority.
ROLE_NAMES = {
    "INFRASTRUCTURE": [".github", ".github/workflows", ".gitlab", ".circleci", "ci", "deploy", "deployment", "terraform", "k8s", "kubernetes", "helm", "docker"],
    "TEST": ["tests", "test", "spec", "specs", "__tests__", "test_utils"],
    "SOURCE": ["src", "lib", "app", "pkg", "internal"],
    "CONFIG": ["config", "configs", "conf", ".config"],
    "DOCUMENTATION": ["docs", "doc", "documentation"],
    "GENERATED": ["dist", "build", "out", "output", ".generated", "__generated__"],
    "VENDOR": ["vendor", "third_party", "thirdparty", "external", "deps"],
    "BUILD_ARTIFACT": ["target", "node_modules", ".gradle", ".cache", ".cargo/registry"],
}
SOURCE_EXTENSIONS = ["rs", "ts", "tsx", "js", "jsx", "py", "go", "java"]
CONFIG_EXTENSIONS = ["toml", "yaml", "yml", "json", "env", "ini"]
DOC_EXTENSIONS = ["md", "rst", "adoc", "html"]
TEST_MARKS = ["_test.", "_spec.", "test_", "spec_", "_test_", "_spec_"]


def service_of(files: DataFrame, services: DataFrame) -> DataFrame:
    """(path, service): the service of the deepest root above a file. services: service, root."""
    placed = longest_prefix(files.select("path"), services.select(F.col("root").alias("prefix")))
    return placed.join(services.select(F.col("root").alias("prefix"), "service"), "prefix").select("path", "service")


def service_map(files: DataFrame, services: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Owners (path, service) and call counts between services from ``calls(source_file, target_file)``."""
    owners = service_of(files, services)
    return owners, cross_service(calls, owners)


def assign_in_order(files: DataFrame, services: DataFrame) -> DataFrame:
    """(path, service): the first service by name whose root is a plain prefix of the path (an empty root is one of every path).
    Paths are cut to each length that a root has, and the cuts joined with the roots, so there may be any number of services."""
    paths = files.where("path is not null").select("path").distinct()
    lengths = services.agg(F.array_sort(F.collect_set(F.char_length("root"))).alias("_lengths"))  # one row, as long as the longest root at most
    cuts = F.transform(F.filter("_lengths", lambda n: n <= F.char_length("path")), lambda n: F.substring("path", F.lit(1), n))
    tried = paths.crossJoin(F.broadcast(lengths)).select("path", F.explode(cuts).alias("root"))
    first = tried.join(services.select("root", "service"), "root").groupBy("path").agg(F.min("service").alias("service"))
    return files.join(first, "path").select("path", "service")


def directories(files: DataFrame) -> DataFrame:
    """(dir, path): every ancestor directory of every file."""
    parts = F.split(normal_path(F.col("path")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return files.where(F.contains("path", F.lit("/"))).select(F.explode(above).alias("dir"), "path")


def _role_by_name(name: Column) -> Column:
    return F.coalesce(*[F.when(name.isin(names), F.lit(role)) for role, names in ROLE_NAMES.items()])


def _role_by_path(path: Column) -> Column:
    """A struct (role, confidence): the special cases, the last name, else the nearest rule of the shortest parent that has one."""
    parts = F.split(F.rtrim(path, F.lit("/")), "/")
    special = F.when(path.rlike(r"(^|/)\.github/workflows$"), "INFRASTRUCTURE").when(path.rlike(r"(^|/)src/tests?$"), "TEST")
    pair = lambda role, confidence: F.struct(role.alias("role"), confidence.cast("double").alias("confidence"))
    own = F.coalesce(special, _role_by_name(F.element_at(parts, -1)))
    # A parent found from the shortest on; each level below it costs a tenth, one half at least.
    upper = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: pair(F.coalesce(F.when(F.array_join(F.slice(parts, 1, i), "/").rlike(r"(^|/)\.github/workflows$"), "INFRASTRUCTURE").when(F.array_join(F.slice(parts, 1, i), "/").rlike(r"(^|/)src/tests?$"), "TEST"), _role_by_name(F.element_at(parts, i))), F.greatest(F.lit(1.0) - (F.size(parts) - i) * 0.1, F.lit(0.5))))
    found = F.element_at(F.filter(upper, lambda s: s["role"].isNotNull()), 1)
    return F.when(own.isNotNull(), pair(own, F.lit(1.0))).when((F.size(parts) > 1) & (F.size(F.filter(upper, lambda s: s["role"].isNotNull())) > 0), found)


def topology(files: DataFrame) -> DataFrame:
    """(dir, role, confidence) of every directory: by its path, else by what most of its files are."""
    rows = directories(files)
    ext = F.regexp_extract("path", r"([^.]*)$", 1)
    test = reduce(lambda a, b: a | b, [F.contains("path", F.lit(m)) for m in TEST_MARKS])
    share = lambda c: F.avg(c.cast("double"))
    infra = F.col("path").endswith("Dockerfile") | F.contains("path", F.lit(".github/")) | (F.col("path").endswith(".yml") & F.contains("path", F.lit("workflow"))) | F.contains("path", F.lit("ci.yml"))
    counted = rows.groupBy("dir").agg(F.max(infra).alias("i"), share(test).alias("t"), share(ext.isin(SOURCE_EXTENSIONS) & ~test).alias("s"), share(ext.isin(CONFIG_EXTENSIONS)).alias("c"), share(ext.isin(DOC_EXTENSIONS)).alias("d"))
    by_content = F.when(F.col("i"), "INFRASTRUCTURE").when(F.col("t") > 0.7, "TEST").when(F.col("s") > 0.7, "SOURCE").when(F.col("c") > 0.7, "CONFIG").when(F.col("d") > 0.7, "DOCUMENTATION")
    confidence = F.when(F.col("i"), 0.7).when(by_content.isNotNull(), 0.6)
    named = counted.withColumn("p", _role_by_path(F.col("dir"))).withColumn("b", by_content).withColumn("bc", confidence)
    use_path = F.col("p").isNotNull() & ((F.col("p.confidence") >= 0.8) | F.col("b").isNull() | (F.col("p.confidence") >= F.col("bc")))
    return named.select("dir", F.when(use_path, F.col("p.role")).otherwise(F.col("b")).alias("role"), F.round(F.when(use_path, F.col("p.confidence")).otherwise(F.col("bc")), 6).alias("confidence")).where("role is not null")


def ci_changes(changes: DataFrame) -> DataFrame:
    """(path, kind) of changed CI files: pre_commit, generated, known or unknown; others are left out."""
    p = normal_path(F.col("path"))
    workflow = p.rlike(r"^\.github/workflows/.*\.ya?ml$")
    kind = (
        F.when(p.isin(".pre-commit-config.yaml", "lefthook.yml") | p.startswith(".husky/"), "pre_commit")
        .when(p.rlike(r"^\.github/workflows/generated-.*\.ya?ml$"), "generated")
        .when(workflow | p.isin(".gitlab-ci.yml", ".circleci/config.yml", ".travis.yml", "azure-pipelines.yml", "Makefile", "makefile", "GNUmakefile") | p.startswith("Jenkinsfile"), "known")
        .when((p.startswith(".github/") & ~p.startswith(".github/workflows/")) | p.startswith(".ci/") | p.startswith("ci/"), "unknown")
    )
    return changes.select("path", kind.alias("kind")).where("kind is not null")


def deploy_manifests(changes: DataFrame) -> DataFrame:
    """(path, manifest_type) of changed deploy manifests by name."""
    name = F.lower(basename(F.col("path")))
    kind = F.when(name.startswith("dockerfile") | name.endswith(".dockerfile"), "Dockerfile").when(name.rlike(r"^(docker-)?compose.*\.ya?ml$"), "DockerCompose").when(name.endswith(".tf"), "Terraform").when(name.isin("chart.yaml", "values.yaml"), "Helm").when(F.col("path").rlike(r"(^|/)(k8s|kubernetes|manifests)/.*\.ya?ml$"), "Kubernetes").when(F.col("path").rlike(r"^\.github/workflows/.*\.ya?ml$"), "CiWorkflow")
    return changes.select("path", kind.alias("manifest_type")).where("manifest_type is not null")


def trace_changes(changes: DataFrame, patterns: list[str]) -> DataFrame:
    """Changed trace configuration (path, risk_weight, is_deleted)."""
    return changes.where(matches_any(F.col("path"), patterns)).select("path", F.lit(5).alias("risk_weight"), (F.col("status") == "Deleted").alias("is_deleted"))


def sdk_delta(before: DataFrame, after: DataFrame, patterns: list[str]) -> DataFrame:
    """(sdk, change): imports that match a pattern (in any case), added, removed or, where their files differ, modified."""
    hit = reduce(lambda a, b: a | b, [F.contains(F.lower("import"), F.lit(p.lower())) for p in patterns], F.lit(False))
    side = lambda df, name: df.where(hit).groupBy(F.col("import").alias("sdk")).agg(F.array_sort(F.collect_set("file_path")).alias(name))
    both = side(before, "b").join(side(after, "a"), "sdk", "full")
    return both.select("sdk", F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "modified").alias("change")).where("change is not null")


def test_mapping(symbols: DataFrame, imports: DataFrame, coverage: DataFrame) -> DataFrame:
    """(test, tested, confidence, kind): a test maps to symbols of files it imports (1.0), of its own stripped name (0.5), and of files that coverage
    names (0.9); the first kind of a pair stays. symbols: id, symbol_name, file_path, is_test, stripped; imports: file_path, target; coverage: test_file, file_path."""
    names = lambda c: F.collect_set(c)
    meant, covered = imports.groupBy("file_path").agg(names("target").alias("_targets")), coverage.groupBy(F.col("test_file").alias("_tf")).agg(names("file_path").alias("_covered"))
    none = F.array().cast("array<string>")
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, none))))
    tests = symbols.where("is_test").join(meant, "file_path", "left").join(covered, F.col("file_path") == F.col("_tf"), "left")
    tests = tests.groupBy(F.col("id").alias("test")).agg(flat(F.col("_targets")).alias("_import"), names("stripped").alias("_naming"), flat(F.col("_covered")).alias("_coverage"))
    rest = symbols.where("not is_test").groupBy(F.col("id").alias("tested")).agg(names("file_path").alias("_files"), names("symbol_name").alias("_names"))
    # Each pair comes once, at the first value that both sides share, and in the first kind that holds; nothing is aggregated after a join.
    found, before = None, F.lit(False)
    for kind, own, theirs, confidence in (("IMPORT", "_import", "_files", 1.0), ("NAMING", "_naming", "_names", 0.5), ("COVERAGE", "_coverage", "_files", 0.9)):
        asked, known = tests.select("*", F.explode(own).alias("_on")), rest.select("*", F.explode(theirs).alias("_with"))
        pairs = asked.join(known, F.col("_on") == F.col("_with")).where((F.col("_on") == F.array_min(F.array_intersect(own, theirs))) & ~before)
        part = pairs.select("test", "tested", F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind"))
        found, before = part if found is None else found.unionByName(part), before | F.arrays_overlap(own, theirs)
    return found
