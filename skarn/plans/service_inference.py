"""Services inferred from topology, routes, calls and models, and the calls between them.

Every piece of evidence (a handler, a caller, a model) votes for the folder its file belongs to; a folder with votes, a marked root and a declared root are services.
A call's two ends belong to the deepest service above their file that holds the symbol, else to the only service that holds it, else to none. Paths are relative, with
forward slashes; the top folder is the empty string or a dot. Members stay rows, so a service may hold any number of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import basename, normal_path
from ..operators.graph import _cut
from ..operators.joins import longest_prefix

#: A folder without a root above it counts to this depth.
DEPTH = 3


def _folder(path: Column) -> Column:
    """The folder of a file; a path without an extension is a folder itself."""
    plain = normal_path(path)
    return F.when(F.rlike(plain, F.lit(r"[^/]\.[^/]*$")), F.regexp_replace(plain, r"/?[^/]*$", "")).otherwise(F.rtrim(plain, F.lit("/")))


def service_folders(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, directory): the deepest of roots(dir) above a path, else its folder's first three parts. A null path has none."""
    folders = paths.where("path is not null").select("path", _folder(F.col("path")).alias("_folder")).distinct()
    found = longest_prefix(folders, roots.select(F.when(F.col("dir") == ".", "").otherwise(F.col("dir")).alias("_root")), "_folder", "_root")
    own = F.array_join(F.slice(F.split("_folder", "/"), 1, DEPTH), "/")
    return found.select("path", F.coalesce("_root", own).alias("directory"))


def infer_services(routes: DataFrame, calls: DataFrame, models: DataFrame, roots: DataFrame, declared: DataFrame, packages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """services(directory, name, declared, routes, models), the last two counts, and members(directory, symbol, kind), distinct.

    routes(path, handler), calls(caller_file, caller_name), models(path, model), roots(dir) of the topology, declared(root, name), the names(dir, package) of manifests. A model counts where something else makes a service.
    A declared name wins, the smallest of several; then the folder's own; the top folder is ``root`` if it is a marked root, else its package's name, else ``unnamed-service-1``.
    Null handlers make a service without a member; null paths give nothing."""
    marked = roots.select(F.when(F.col("dir") == ".", "").otherwise(F.rtrim("dir", F.lit("/"))).alias("directory")).distinct()
    named = declared.select(F.when(F.col("root") == ".", "").otherwise(F.rtrim("root", F.lit("/"))).alias("directory"), "name").groupBy("directory").agg(F.min("name").alias("declared_name"))
    rows = lambda df, path, symbol, kind: df.select(F.col(path).alias("path"), F.col(symbol).alias("symbol"), F.lit(kind).alias("kind"))
    evidence = rows(routes, "path", "handler", "route").unionByName(rows(calls, "caller_file", "caller_name", "route")).unionByName(rows(models, "path", "model", "model"))
    # Services and members both come from the votes, and callers use both several times.
    votes = _cut(evidence.join(_cut(service_folders(_cut(evidence.select("path").distinct()), roots)), "path").select("directory", "symbol", "kind").distinct())
    services = votes.where("kind = 'route'").select("directory").unionByName(marked).unionByName(named.select("directory")).distinct()
    members = votes.where("symbol is not null").join(services, "directory", "left_semi")
    counts = members.groupBy("directory").agg(F.count_if(F.col("kind") == "route").alias("routes"), F.count_if(F.col("kind") == "model").alias("models"))
    full = services.join(named, "directory", "left").join(marked.withColumn("_marked", F.lit(True)), "directory", "left").join(counts, "directory", "left")
    full = full.join(packages.groupBy(F.col("dir").alias("directory")).agg(F.min("package").alias("_package")), "directory", "left") if packages is not None else full.withColumn("_package", F.lit(None).cast("string"))
    own = F.when(F.col("directory") != "", basename(F.col("directory"))).when(F.col("_marked"), "root").otherwise(F.coalesce("_package", F.lit("unnamed-service-1")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return full.select("directory", F.coalesce("declared_name", own).alias("name"), F.col("declared_name").isNotNull().alias("declared"), zero("routes"), zero("models")), members


def _bases(files: DataFrame, held: DataFrame) -> DataFrame:
    """(file, base, top) of distinct files(file) that aren't null: the deepest folder with members above a file, which tells all the others above it, but for the top folder: that
    holds files that lie in it (top). Null: none. There are as many rows as files, so that calls are not multiplied by the folders above them."""
    files = files.where("file is not null").distinct()
    parts = F.split(normal_path(F.col("file")), "/")
    above = F.transform(F.sequence(F.when(F.size(parts) == 1, 0).otherwise(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    tried = files.select("file", (F.size(parts) == 1).alias("top"), F.explode(above).alias("directory"))
    known = held.select("directory").distinct().withColumn("_base", F.col("directory"))
    return tried.join(known, "directory", "left").groupBy("file", "top").agg(F.max_by("_base", F.char_length("_base")).alias("base"))


def _placed(rows: DataFrame, file: str, bases: DataFrame, base: str, top: str) -> DataFrame:
    """rows with the base of a file; rows without a file have none, and stay where they are."""
    named = bases.select(F.col("file").alias(file), F.col("base").alias(base), F.col("top").alias(top))
    bare = rows.where(F.col(file).isNull()).withColumn(base, F.lit(None).cast("string")).withColumn(top, F.lit(False))
    return rows.where(F.col(file).isNotNull()).join(named, file).unionByName(bare)


def _owners(uses: DataFrame, services: DataFrame, held: DataFrame) -> DataFrame:
    """(symbol, base, top, service) of uses(symbol, base, top) that belong to a service."""
    wanted = uses.where("symbol is not null").distinct()
    parts = F.split("base", "/")
    upward = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    above = F.when(F.col("top") & (F.col("base") != ""), F.concat(upward, F.array(F.lit("")))).otherwise(upward)
    near = wanted.where("base is not null").select("symbol", "base", "top", F.explode(above).alias("directory")).join(held, ["symbol", "directory"])
    deepest = near.groupBy("symbol", "base", "top").agg(F.max_by("directory", F.char_length("directory")).alias("near"))
    alone = held.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("directory").alias("only")).where("n = 1").select("symbol", "only")
    both = wanted.where("base is not null").join(deepest, ["symbol", "base", "top"], "left").unionByName(wanted.where("base is null").withColumn("near", F.lit(None).cast("string"))).join(alone, "symbol", "left")
    placed = both.select("symbol", "base", "top", F.coalesce("near", "only").alias("directory")).where("directory is not null")
    return placed.join(services.select("directory", F.col("name").alias("service")), "directory").select("symbol", "base", "top", "service")


def _same(symbol: str, base: str, top: str) -> Column:
    """Whether an owner (_s, _b, _t) is that of a symbol and a base."""
    return (F.col(symbol) == F.col("_s")) & F.col(base).eqNullSafe(F.col("_b")) & (F.col(top) == F.col("_t"))


def symbol_services(uses: DataFrame, services: DataFrame, members: DataFrame) -> DataFrame:
    """(symbol, file, service) of distinct uses(symbol, file) that belong to a service; a null file goes by the symbol alone. The top folder's service holds only files that lie in it."""
    wanted, held = uses.where("symbol is not null").select("symbol", "file").distinct(), _cut(members.select("directory", "symbol").distinct())
    based = _placed(wanted, "file", _bases(uses.select("file"), held), "base", "top")
    owners = _owners(based.select("symbol", "base", "top"), services, held).select(F.col("symbol").alias("_s"), F.col("base").alias("_b"), F.col("top").alias("_t"), "service")
    return based.join(owners, _same("symbol", "base", "top")).select("symbol", "file", "service")


def service_calls(calls: DataFrame, services: DataFrame, members: DataFrame) -> DataFrame:
    """(caller_service, callee_service, calls): calls(caller_name, caller_file, callee_name, callee_file) between services of different names; callee_file may be null.

    A call's ends are placed by their files' bases before calls are counted, so that calls of the same names between the same folders are one row from then on."""
    held = _cut(members.select("directory", "symbol").distinct())
    bases = _cut(_bases(calls.select(F.col("caller_file").alias("file")).unionByName(calls.select(F.col("callee_file").alias("file"))), held))
    out = calls.select("caller_name", "caller_file", "callee_name", "callee_file")
    ends = [f"{end}_{part}" for end in ("caller", "callee") for part in ("name", "base", "top")]
    for end in ("caller", "callee"):
        out = _placed(out, f"{end}_file", bases, f"{end}_base", f"{end}_top")
    out = _cut(out.groupBy(*ends).agg(F.count(F.lit(1)).alias("n")))
    uses = [out.select(*[F.col(f"{end}_{part}").alias(name) for part, name in (("name", "symbol"), ("base", "base"), ("top", "top"))]) for end in ("caller", "callee")]
    owners = _cut(_owners(uses[0].unionByName(uses[1]), services, held))
    for end in ("caller", "callee"):
        own = owners.select(F.col("symbol").alias("_s"), F.col("base").alias("_b"), F.col("top").alias("_t"), F.col("service").alias(f"{end}_service"))
        out = out.join(own, _same(f"{end}_name", f"{end}_base", f"{end}_top")).drop("_s", "_b", "_t")
    return out.where("caller_service <> callee_service").groupBy("caller_service", "callee_service").agg(F.sum("n").alias("calls"))
