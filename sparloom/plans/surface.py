"""The operators as SQL functions of a session: register(spark), then plain SQL with LATERAL.

Scalar and table functions that Spark SQL can express are SQL functions, which the optimizer inlines;
parsers are Python table functions. Names carry the prefix `aux_`.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparloom.operators import json_nodes as J
from sparloom.operators import xml_nodes as X

# name and parameters -> result and body
SCALARS = {
    "aux_norm_name(s STRING)": ("STRING", "concat(upper(left(trim(s), 1)), lower(substr(trim(s), 2)))"),
    "aux_int_to_bin(n BIGINT, adjust INT)": ("STRING", "lpad(if(n < 0, string(n), bin(n)), int(ceil(length(if(n < 0, string(n), bin(n))) / adjust) * adjust), '0')"),
    "aux_ci_replace(s STRING, what STRING, new STRING)": ("STRING", "if(what = '', s, regexp_replace(s, concat('(?iu)\\\\Q', replace(what, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'), regexp_replace(new, '[\\\\\\\\$]', '\\\\\\\\$0')))"),
    "aux_xml_escape(s STRING)": ("STRING", "replace(replace(replace(replace(replace(s, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '\\'', '&apos;')"),
    "aux_obfuscate(s STRING)": ("STRING", "concat_ws('', transform(split(s, ''), c -> concat(string(ascii(c)), ',')))"),
}
TABLES = {
    "aux_split_text(s STRING, delimiter STRING, trim_part INT)": (
        "idx BIGINT, part STRING",
        """SELECT i + 1, if(trim_part = 1 AND s <> '' AND delimiter <> '', trim(p), p)
FROM (SELECT s, delimiter, trim_part, if(delimiter = '', array(s), split(s, concat('\\\\Q', delimiter, '\\\\E'))) AS l) AS a,
LATERAL posexplode(if(length(delimiter) = 1 AND endswith(s, delimiter), slice(l, 1, size(l) - 1), l)) AS t(i, p)""",
    ),
}


def _rows(fields: str, parse):
    names = [f.split(":")[0] for f in fields.split(",")]

    def of(*args):
        for r in parse(*args):
            yield tuple(r[n] for n in names)

    return of


def _udtf(fields: str, parse):
    rows = _rows(fields, parse)

    class Parse:
        def eval(self, *args):
            yield from rows(*args)

    return udtf(Parse, returnType=", ".join(f.replace(":", " ") for f in fields.split(",")))


_VALUE = "json_length:bigint,node_pos:bigint,value_type:string,value_block_pos:bigint,value_block:string,value_block_length:bigint,val:string,val_int:bigint"
_FOUND = "node:string,node_path:string,node_index:bigint,node_type:string,node_start:bigint,node_end:bigint,node_level:bigint,node_name:string,value_name:string,value_type:string,val:string"
PARSERS = {
    "aux_json_parse": (J.NODE, J.parse),
    "aux_json_get_node": (_FOUND, J.get_node),
    "aux_json_get_value": (_VALUE, J.get_values),
    "aux_xml_all_nodes": (X.NODE, X.nodes),
    "aux_xml_get_value": (X.VALUE, X.values),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; their names."""
    for head, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, (fields, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE({fields}) RETURN {body}")
    for name, (fields, parse) in PARSERS.items():
        spark.udtf.register(name, _udtf(fields, parse))
    return [h.partition("(")[0] for h in (*SCALARS, *TABLES)] + list(PARSERS)
