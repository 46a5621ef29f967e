"""Registered queries of inferred services."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .plans.service_inference import infer_services, service_calls
from .queries import Inputs, query

_BOUND = ("service_routes", "service_calls", "service_models")
_FOLDER = "CASE WHEN path LIKE 'src/%' THEN 'src' WHEN path LIKE 'a/b/%' THEN 'a/b' ELSE array_to_string(string_split(regexp_replace(path, '/[^/]*$', ''), '/')[1:3], '/') END"
_MEMBERS = f", ev AS (SELECT path, handler AS symbol, 'route' AS kind FROM service_routes UNION SELECT caller_file, caller_name, 'route' FROM service_calls UNION SELECT path, model, 'model' FROM service_models), vo AS (SELECT DISTINCT {_FOLDER} AS directory, symbol, kind FROM ev), se AS (SELECT directory, CASE directory WHEN 'tools' THEN 'toolbox' ELSE regexp_extract(directory, '[^/]*$') END AS name FROM (SELECT directory FROM vo WHERE kind = 'route' UNION SELECT unnest(['src', 'a/b', 'tools'])) q), me AS (SELECT * FROM vo WHERE directory IN (SELECT directory FROM se))"
_ABOVE = "(path LIKE me.directory || '/%')"
_OWNERS = f", us AS (SELECT caller_name AS symbol, caller_file AS path FROM service_calls UNION SELECT callee_name, callee_file FROM service_calls), hd AS (SELECT DISTINCT directory, symbol FROM me), nr AS (SELECT us.symbol, path, arg_max(me.directory, length(me.directory)) AS directory FROM us JOIN hd me ON me.symbol = us.symbol AND {_ABOVE} GROUP BY 1, 2), al AS (SELECT symbol, min(directory) AS directory FROM hd GROUP BY 1 HAVING count(*) = 1), ow AS (SELECT us.symbol, us.path, name AS service FROM us LEFT JOIN nr ON nr.symbol = us.symbol AND nr.path = us.path LEFT JOIN al ON al.symbol = us.symbol JOIN se ON se.directory = coalesce(nr.directory, al.directory))"


def _inferred(t: Inputs) -> tuple[DataFrame, DataFrame]:
    make = t.spark.createDataFrame
    return infer_services(t("service_routes"), t("service_calls"), t("service_models"), make([("src",), ("a/b",)], "dir string"), make([("tools", "toolbox")], "root string, name string"))


@query("c16_inferred_services", _MEMBERS + " SELECT se.directory, name, name = 'toolbox' AS declared, count(*) FILTER (kind = 'route') AS routes, count(*) FILTER (kind = 'model') AS models FROM se LEFT JOIN me ON me.directory = se.directory GROUP BY ALL", *_BOUND)
def _(t: Inputs) -> DataFrame:
    return _inferred(t)[0]


@query("c16_inferred_calls", _MEMBERS + _OWNERS + " SELECT a.service AS caller_service, b.service AS callee_service, count(*) AS calls FROM service_calls c JOIN ow a ON a.symbol = c.caller_name AND a.path = c.caller_file JOIN ow b ON b.symbol = c.callee_name AND b.path IS NOT DISTINCT FROM c.callee_file WHERE a.service <> b.service GROUP BY 1, 2", *_BOUND)
def _(t: Inputs) -> DataFrame:
    return service_calls(t("service_calls"), *_inferred(t))
