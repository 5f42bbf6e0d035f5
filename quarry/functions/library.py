"""The dialect's functions as Spark SQL text.

lower(name, args) turns a call, whose arguments are Spark SQL texts, into Spark SQL; names that
Spark has under the same meaning pass through. A few functions have no SQL form and are
registered as Arrow-batched Python functions (register).
"""

from __future__ import annotations

import hashlib
import html
import json
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import fuzzy

Lowering = Callable[[list[str]], str]

#: Functions whose Spark name and meaning are the same.
SAME = set(
    """avg corr count covar_pop covar_samp max median min sum bit_count greatest least try_cast current_date day hour minute month second year now
    levenshtein soundex abs acos asin atan atan2 ceil ceiling cos cot degrees exp floor log10 pi pow power radians rand sign sin sqrt tan ln
    coalesce ifnull nullif nvl nvl2 regexp_count ascii char char_length character_length octet_length concat_ws initcap instr left lower lpad ltrim
    position repeat replace reverse right rpad rtrim space split_part substr substring translate upper cume_dist dense_rank first_value lag
    last_value lead nth_value ntile percent_rank rank row_number every any some approx_count_distinct stddev_samp date_part extract overlay trim""".split()
)

#: Renamed functions.
RENAMED = {
    "STDDEV": "stddev_samp", "STDEV": "stddev_samp", "STDEVP": "stddev_pop", "VAR": "var_samp", "VARP": "var_pop", "STRING_AGG": "listagg", "LISTAGG": "listagg",
    "REMOVE_FROM_LIST": "array_remove", "DATALENGTH": "octet_length", "REPLICATE": "repeat", "UNICODE": "ascii", "RANDOM": "rand", "GETDATE": "localtimestamp",
    "SYSDATE": "localtimestamp", "EXTRACTVALUE": "xpath_string", "XMLVALUE": "xpath_string", "JSON_EXTRACT": "get_json_object", "DATETRUNC": "date_trunc",
}

_UNITS = {"yy": "year", "yyyy": "year", "qq": "quarter", "q": "quarter", "mm": "month", "m": "month", "dy": "dayofyear", "y": "dayofyear", "dd": "day", "d": "day", "wk": "week", "ww": "week", "dw": "weekday", "hh": "hour", "mi": "minute", "n": "minute", "ss": "second", "s": "second", "ms": "millisecond", "mcs": "microsecond"}


def unit(text: str) -> str:
    """A date part's full name, from a bare or quoted name or abbreviation."""
    name = text.strip().strip("'\"").lower()
    return _UNITS.get(name, name)


def _trunc(part: str, x: str) -> str:
    # weeks begin on Sunday for boundary counts
    return f"date_sub(cast({x} as date), dayofweek({x}) - 1)" if part == "week" else f"date_trunc('{part}', {x})"


def _datediff(a: list[str]) -> str:
    part, x, y = unit(a[0]), f"cast({a[1]} as timestamp_ntz)", f"cast({a[2]} as timestamp_ntz)"
    if part in ("day", "dayofyear", "weekday"):
        return f"datediff({y}, {x})"
    if part == "week":
        return f"cast(datediff({_trunc(part, y)}, {_trunc(part, x)}) div 7 as int)"
    if part in ("year", "quarter", "month"):
        months = f"(year({y}) * 12 + month({y}) - year({x}) * 12 - month({x}))"
        return {"month": f"({months})", "quarter": f"((year({y}) - year({x})) * 4 + quarter({y}) - quarter({x}))", "year": f"(year({y}) - year({x}))"}[part]
    return f"cast(timestampdiff({part.upper()}, date_trunc('{part}', {x}), date_trunc('{part}', {y})) as int)"


def _datepart(a: list[str]) -> str:
    part, x = unit(a[0]), a[1]
    return {"weekday": f"dayofweek({x})", "dayofyear": f"dayofyear({x})", "week": f"weekofyear({x})", "millisecond": f"cast(date_format({x}, 'SSS') as int)"}.get(part, f"cast(date_part('{part}', {x}) as int)")


def _datename(a: list[str]) -> str:
    part = unit(a[0])
    pattern = {"month": "MMMM", "weekday": "EEEE"}.get(part)
    return f"date_format({a[1]}, '{pattern}')" if pattern else f"cast({_datepart(a)} as string)"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _last_four(prefix: str) -> Lowering:
    return lambda a: f"case when {a[0]} is null then null when length({_digits(a[0])}) < 4 then '{prefix}****' else concat('{prefix}', right({_digits(a[0])}, 4)) end"


_TYPES = {"int": "int", "integer": "int", "bigint": "bigint", "smallint": "smallint", "tinyint": "smallint", "bit": "boolean", "bool": "boolean", "boolean": "boolean", "float": "double", "double": "double", "real": "float", "money": "decimal(19,4)", "varchar": "string", "nvarchar": "string", "char": "string", "nchar": "string", "text": "string", "string": "string", "varchar2": "string", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz", "timestamp": "timestamp_ntz", "datetimeoffset": "timestamp", "date": "date", "varbinary": "binary", "binary": "binary", "blob": "binary", "image": "binary", "uniqueidentifier": "string", "uuid": "string", "guid": "string", "json": "string", "xml": "string", "markdown": "string", "path": "string", "time": "string"}


def spark_type(text: str) -> str:
    """A declared type as Spark's: DECIMAL without precision is (38,18), text lengths are not enforced by casts."""
    m = re.match(r"\s*(\w+)\s*(?:\(([^)]*)\))?", text)
    name, inner = m[1].lower(), m[2]
    if name in ("decimal", "numeric"):
        if inner:
            p, _, s = inner.partition(",")
            return f"decimal({int(p)},{int(s or 0)})"
        return "decimal(38,18)"
    return _TYPES.get(name, name)


def cast(x: str, kind: str, attempt: bool = False) -> str:
    """CAST or TRY_CAST: to integers by way of a decimal, truncating; other casts are Spark's."""
    t, f = spark_type(kind), "try_cast" if attempt else "cast"
    if t in ("int", "bigint", "smallint"):
        return f"{f}(coalesce(try_cast({x} as decimal(38,10)), {f}({x} as {t})) as {t})"
    if t == "string":
        return f"{f}({x} as string)"
    if t == "binary":
        return f"unbase64({x})"
    return f"{f}({x} as {t})"


_STYLES = {"101": "MM/dd/yyyy", "102": "yyyy.MM.dd", "103": "dd/MM/yyyy", "104": "dd.MM.yyyy", "105": "dd-MM-yyyy", "108": "HH:mm:ss", "110": "MM-dd-yyyy", "111": "yyyy/MM/dd", "112": "yyyyMMdd", "120": "yyyy-MM-dd HH:mm:ss", "121": "yyyy-MM-dd HH:mm:ss.SSS", "126": "yyyy-MM-dd'T'HH:mm:ss"}


def _convert(a: list[str], attempt: bool = False) -> str:
    if len(a) > 2 and a[2].strip() in _STYLES:
        pattern, t = _STYLES[a[2].strip()].replace("'", "\\'"), spark_type(a[0])
        if t == "string":
            return f"date_format({a[1]}, '{pattern}')"
        f = "try_to_timestamp" if attempt else "to_timestamp"
        return f"cast({f}({a[1]}, '{pattern}') as {t})"
    return cast(a[1], a[0], attempt)


def _decode(a: list[str]) -> str:
    pairs = a[1:]
    out = "case"
    for i in range(0, len(pairs) - 1, 2):
        out += f" when {a[0]} <=> {pairs[i]} then {pairs[i + 1]}"
    return out + (f" else {pairs[-1]}" if len(pairs) % 2 else "") + " end"


def _hash(a: list[str]) -> str:
    name = a[0].strip().strip("'\"").upper()
    inner = {"MD5": f"md5({a[1]})", "SHA1": f"sha1({a[1]})", "SHA256": f"sha2({a[1]}, 256)", "SHA2_256": f"sha2({a[1]}, 256)", "SHA512": f"sha2({a[1]}, 512)", "SHA2_512": f"sha2({a[1]}, 512)"}[name]
    return f"unhex({inner})"


def _checksum(a: list[str]) -> str:
    return "xxhash64(" + ", ".join(f"coalesce(cast({x} as string), '\\u0000')" for x in a) + ")"


def _flags(pattern: str, flags: str | None) -> str:
    """A pattern with inline flags in front."""
    f = (flags or "").strip().strip("'")
    return f"concat('(?{f})', {pattern})" if f else pattern


def _from(s: str, position: str | None) -> str:
    return f"substring({s}, {position})" if position and position.strip() != "1" else s


def _get(a: list[str], i: int) -> str | None:
    return a[i] if len(a) > i else None


def _regexp_like(a: list[str]) -> str:
    return f"coalesce(cast({a[0]} rlike {_flags(a[1], _get(a, 2))} as int), 0)"


def _regexp_substr(a: list[str]) -> str:
    p, s = _flags(a[1], _get(a, 4)), _from(a[0], _get(a, 2))
    return f"try_element_at(regexp_extract_all({s}, {p}, 0), {_get(a, 3) or 1})"


def _regexp_instr(a: list[str]) -> str:
    p, s, k = _flags(a[1], _get(a, 5)), _from(a[0], _get(a, 2)), _get(a, 3) or "1"
    shift = f"({a[2]}) - 1" if len(a) > 2 else "0"
    # the pieces before the k-th match, and the matches among them, give its place
    before = f"aggregate(slice(split({s}, {p}, -1), 1, {k}), 0, (n, x) -> n + length(x)) + aggregate(slice(regexp_extract_all({s}, {p}, 0), 1, {k} - 1), 0, (n, x) -> n + length(x))"
    extra = f" + case when {_get(a, 4)} = 1 then length(element_at(regexp_extract_all({s}, {p}, 0), {k})) else 0 end" if len(a) > 4 else ""
    return f"case when {a[0]} is null or {a[1]} is null then null when size(regexp_extract_all({s}, {p}, 0)) >= {k} then {before} + 1 + {shift}{extra} else 0 end"


def _regexp_replace(a: list[str]) -> str:
    p = _flags(a[1], _get(a, 5))
    r = re.sub(r"\\+(\d)", r"$\1", a[2])
    s = _from(a[0], _get(a, 3))
    head = f"left({a[0]}, ({a[3]}) - 1)" if len(a) > 3 and a[3].strip() != "1" else None
    k = (_get(a, 4) or "0").strip()
    if k == "0":
        out = f"regexp_replace({s}, {p}, {r})"
    else:
        pieces, found = f"split({s}, {p}, -1)", f"regexp_extract_all({s}, {p}, 0)"
        out = f"array_join(zip_with({pieces}, transform({found}, (m, i) -> case when i + 1 = {k} then regexp_replace(m, {p}, {r}) else m end), (x, y) -> concat(x, coalesce(y, ''))), '')"
    return f"concat({head}, {out})" if head else out


def _like_regex(pattern: str) -> str:
    quoted = f"regexp_replace({pattern}, '([.\\\\\\\\^$|?*+()\\\\[\\\\]{{}}])', '\\\\\\\\$1')"
    return f"replace(replace({quoted}, '%', '.*'), '_', '.')"


def _patindex(a: list[str]) -> str:
    text = a[0].strip()
    if not (text.startswith("'") and text.endswith("'")):
        body = f"regexp_replace({_like_regex(a[0])}, '^([.][*])', '')"
        return f"case when {a[1]} is null or {a[0]} is null then null when startswith({a[0]}, '%') then case when size(regexp_extract_all({a[1]}, concat('(?is)', {body}), 0)) > 0 then length(element_at(split({a[1]}, concat('(?is)', {body}), 2), 1)) + 1 else 0 end else cast({a[1]} rlike concat('(?is)^', {body}) as int) end"
    like = text[1:-1]
    start, end = not like.startswith("%"), not like.endswith("%")
    body = "".join({"%": ".*?", "_": "."}.get(c, re.escape(c)) for c in like.strip("%"))
    p = ("^" if start else "") + body + ("$" if end else "")
    lit = "'(?is)" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"case when {a[1]} is null then null when {a[1]} rlike {lit} then length(element_at(split({a[1]}, {lit}, 2), 1)) + 1 else 0 end"


def _value_bucket(a: list[str]) -> str:
    limits = f"filter(transform(split({a[1]}, ','), t -> try_cast(trim(t) as double)), t -> t is not null)"
    labels = f"transform(split({a[2]}, ','), t -> trim(t))"
    place = f"size(filter({limits}, t -> t < try_cast({a[0]} as double))) + 1"
    return f"case when try_cast({a[0]} as double) is null then null else element_at({labels}, least({place}, size({labels}))) end"


def _xml_escape(x: str) -> str:
    return f"replace(replace(replace(cast({x} as string), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def _xml_attributes(a: list[str]) -> str:
    parts = [f"case when {a[i + 1]} is not null then concat(' ', {a[i]}, '=\"', replace({_xml_escape(a[i + 1])}, '\"', '&quot;'), '\"') else '' end" for i in range(0, len(a), 2)]
    return f"concat({', '.join(parts)})"


def _xml_element(a: list[str]) -> str:
    attributes = a[1] if len(a) > 2 or len(a) > 1 and "'=\"'" in a[1] else None
    content = a[2:] if attributes else a[1:]
    body = ", ".join(f"case when {c} is null then '' when startswith(cast({c} as string), '<') then cast({c} as string) else {_xml_escape(c)} end" for c in content) or "''"
    return f"concat('<', {a[0]}, {attributes or chr(39) * 2}, '>', {body}, '</', {a[0]}, '>')"


def _xml_forest(a: list[str]) -> str:
    parts = [f"case when {a[i + 1]} is not null then concat('<', {a[i]}, '>', {_xml_escape(a[i + 1])}, '</', {a[i]}, '>') end" for i in range(0, len(a), 2)]
    return f"nullif(concat_ws('', {', '.join(parts)}), '')"


def _json_of(x: str) -> str:
    return f"coalesce(regexp_extract(to_json(struct({x} as v)), '(?s)^\\\\{{\"v\":(.*)\\\\}}$', 1), '')"


def _json_item(x: str) -> str:
    return f"case when {x} is null then 'null' else {_json_of(x)} end"


def _json_array(a: list[str]) -> str:
    return "concat('[', " + (", ',', ".join(_json_item(x) for x in a) or "''") + ", ']')"


def _json_object(a: list[str]) -> str:
    parts = [f"concat({_json_of(f'cast({a[i]} as string)')}, ':', {_json_item(a[i + 1])})" for i in range(0, len(a), 2)]
    return "concat('{', concat_ws(',', " + ", ".join(parts) + "), '}')" if parts else "'{}'"


def _json_path(key: str) -> str:
    k = key.strip()
    if re.fullmatch(r"\d+", k):
        return f"'$[{k}]'"
    return f"'$.{k[1:-1]}'" if k.startswith("'") else f"concat('$.', {k})"


def _json_get(a: list[str], text: bool) -> str:
    k = a[1].strip()
    if re.fullmatch(r"-\d+", k):
        item = f"try_element_at(from_json({a[0]}, 'array<variant>'), {k})"
        return f"try_variant_get({item}, '$', 'string')" if text else f"to_json({item})"
    if text:
        return f"get_json_object({a[0]}, {_json_path(k)})"
    return f"to_json(try_variant_get(try_parse_json({a[0]}), {_json_path(k)}, 'variant'))"


def _with_months(a: list[str], x: str) -> str:
    return f"add_months({x}, {a[1]})" if len(a) > 1 else x


LOWERED: dict[str, Lowering] = {
    # bits
    "BITAND": lambda a: f"({a[0]} & {a[1]})",
    "BITOR": lambda a: f"({a[0]} | {a[1]})",
    "BITXOR": lambda a: f"({a[0]} ^ {a[1]})",
    "BITNOT": lambda a: f"(~{a[0]})",
    "BITSHIFTLEFT": lambda a: f"shiftleft(cast({a[0]} as bigint), cast({a[1]} as int))",
    "BITSHIFTRIGHT": lambda a: f"shiftright(cast({a[0]} as bigint), cast({a[1]} as int))",
    # lists
    "ADD_TO_LIST": lambda a: f"array_append(coalesce({a[0]}, array()), {a[1]})",
    "APPEND_TO_LIST": lambda a: f"array_append(coalesce({a[0]}, array()), {a[1]})",
    "SORT_LIST": lambda a: f"sort_array({a[0]}, {'false' if len(a) > 1 and 'desc' in a[1].lower() else 'true'})",
    # conversion
    "CONVERT": _convert,
    "TRY_CONVERT": lambda a: _convert(a, True),
    "PARSE": lambda a: cast(a[0], a[1].strip("'")),
    "TRY_PARSE": lambda a: cast(a[0], a[1].strip("'"), True),
    "DECODE": _decode,
    "IIF": lambda a: f"case when {a[0]} then {a[1]} else {a[2]} end",
    "CHECKSUM": _checksum,
    "BINARY_CHECKSUM": _checksum,
    "HASHBYTES": _hash,
    # dates
    "CURRENT_TIME": lambda a: "date_format(current_timestamp(), 'HH:mm:ss')",
    "CURRENT_TIMESTAMP": lambda a: "cast(to_utc_timestamp(current_timestamp(), current_timezone()) as timestamp_ntz)",
    "DATE_PART": _datepart,
    "DATEPART": _datepart,
    "EXTRACT": _datepart,
    "DATENAME": _datename,
    "DATE_TRUNC": lambda a: f"date_trunc('{unit(a[0])}', {a[1]})",
    "DATETRUNC": lambda a: f"date_trunc('{unit(a[0])}', {a[1]})",
    "DATEADD": lambda a: f"timestampadd({ {'weekday': 'DAY', 'dayofyear': 'DAY'}.get(unit(a[0]), unit(a[0]).upper()) }, cast({a[1]} as int), cast({a[2]} as timestamp_ntz))",
    "DATEDIFF": _datediff,
    "DATETIMEFROMPARTS": lambda a: f"make_timestamp_ntz({', '.join(a[:5])}, {a[5]} + {a[6]} / 1000.0)",
    "DATETIMEOFFSETSFROMPARTS": lambda a: f"make_timestamp({', '.join(a[:5])}, {a[5]} + {a[6]} / power(10, {a[9] if len(a) > 9 else 7}), concat(case when {a[7]} < 0 then '-' else '+' end, lpad(cast(abs({a[7]}) as string), 2, '0'), ':', lpad(cast({a[8]} as string), 2, '0')))",
    "TIMEFROMPARTS": lambda a: f"concat(format_string('%02d:%02d:%02d', {a[0]}, {a[1]}, {a[2]}), case when {a[4]} > 0 then concat('.', lpad(cast({a[3]} as string), {a[4]}, '0')) else '' end)",
    "EOMONTH": lambda a: f"last_day({_with_months(a, a[0])})",
    "END_OF_MONTH": lambda a: f"last_day({_with_months(a, a[0])})",
    "START_OF_MONTH": lambda a: f"trunc({_with_months(a, a[0])}, 'MM')",
    "START_OF_QUARTER": lambda a: f"trunc({a[0]}, 'QUARTER')",
    "END_OF_QUARTER": lambda a: f"last_day(add_months(trunc({a[0]}, 'QUARTER'), 2))",
    "START_OF_WEEK": lambda a: f"date_sub({a[0]}, dayofweek({a[0]}) - 1)",
    "END_OF_WEEK": lambda a: f"date_add({a[0]}, 7 - dayofweek({a[0]}))",
    "SAME_PERIOD_LAST_YEAR": lambda a: f"add_months({a[0]}, -12)",
    "ISDATE": lambda a: f"cast(try_cast({a[0]} as timestamp) is not null as int)",
    "TO_DATE": lambda a: f"try_to_date({', '.join(a)})",
    "TO_TIMESTAMP": lambda a: f"cast(timestamp_seconds({a[0]}) as timestamp_ntz)",
    "TRUNC": lambda a: f"date_trunc('DAY', {a[0]})",
    # fuzzy
    "SIMILARITY": lambda a: f"q_similarity({a[0]}, {a[1]}, {a[2] if len(a) > 2 else chr(39) + 'JAROWINKLER' + chr(39)})",
    "METAPHONE": lambda a: f"q_metaphone({a[0]})",
    "DMETAPHONE": lambda a: f"q_dmetaphone({a[0]})",
    "DMETAPHONE_ALT": lambda a: f"q_dmetaphone_alt({a[0]})",
    "NORMALIZE": lambda a: f"q_normalize({a[0]}, {a[1] if len(a) > 1 else chr(39) * 2})",
    "DIFFERENCE": lambda a: f"aggregate(zip_with(split(soundex({a[0]}), ''), split(soundex({a[1]}), ''), (x, y) -> cast(x = y as int)), 0, (n, v) -> n + coalesce(v, 0))",
    # JSON and XML
    "ISJSON": lambda a: f"cast(try_parse_json({a[0]}) is not null as int)",
    "JSON_ARRAY": _json_array,
    "JSON_OBJECT": _json_object,
    "JSON_EXISTS": lambda a: f"coalesce(cast(try_variant_get(try_parse_json({a[0]}), {a[1]}, 'variant') is not null as int), 0)",
    "JSON_GET": lambda a: _json_get(a, False),
    "JSON_GET_TEXT": lambda a: _json_get(a, True),
    "JSON_VALUE": lambda a: f"case when try_variant_get(try_parse_json({a[0]}), {a[1]}, 'map<string,variant>') is null and try_variant_get(try_parse_json({a[0]}), {a[1]}, 'array<variant>') is null then get_json_object({a[0]}, {a[1]}) end",
    "JSON_QUERY": lambda a: f"q_json_query({a[0]}, {a[1] if len(a) > 1 else chr(39) + '$' + chr(39)})",
    "JSON_MODIFY": lambda a: f"q_json_modify({a[0]}, {a[1]}, cast({a[2]} as string))",
    "XMLATTRIBUTES": _xml_attributes,
    "XMLELEMENT": _xml_element,
    "XMLFOREST": _xml_forest,
    "XMLEXISTS": lambda a: f"cast(xpath_boolean({a[0]}, {a[1]}) as int)",
    "XMLQUERY": lambda a: f"q_xml_query({a[0]}, {a[1]})",
    # numbers
    "AGE_BUCKET": lambda a: f"case when try_cast({a[0]} as double) < 0 then 'Current' when try_cast({a[0]} as double) <= 30 then '0-30' when try_cast({a[0]} as double) <= 60 then '31-60' when try_cast({a[0]} as double) <= 90 then '61-90' when try_cast({a[0]} as double) <= 120 then '91-120' when try_cast({a[0]} as double) > 120 then '120+' end",
    "VALUE_BUCKET": _value_bucket,
    "LOG": lambda a: f"log({a[1]}, {a[0]})" if len(a) > 1 else f"ln({a[0]})",
    "MOD": lambda a: f"try_mod({a[0]}, {a[1]})",
    "QUOTIENT": lambda a: f"case when {a[1]} = 0 then null else cast({a[0]} as bigint) div cast({a[1]} as bigint) end",
    "ROUND": lambda a: f"round(cast({a[0]} as decimal(38,10)), {a[1] if len(a) > 1 else 0})",
    "SAFE_DIVIDE": lambda a: f"coalesce(try_divide(try_cast({a[0]} as double), try_cast({a[1]} as double)), try_cast({a[2] if len(a) > 2 else 0} as double), 0D)",
    "TRUNCATE": lambda a: f"(sign({a[0]}) * floor(abs(cast({a[0]} as decimal(38,10))) * power(10, {a[1]})) / power(10, {a[1]}))",
    # nulls
    "IS_NULL": lambda a: f"({a[0]} is null)",
    "IS_NOT_NULL": lambda a: f"({a[0]} is not null)",
    "ISNULL": lambda a: f"nvl({a[0]}, {a[1]})" if len(a) > 1 else f"isnull({a[0]})",
    # random
    "NEWID": lambda a: "uuid()",
    "NEWSEQUENTIALID": lambda a: "uuid()",
    "RANDOM_DECIMAL": lambda a: f"cast({a[0]} + rand() * ({a[1]} - {a[0]}) as decimal(38,4))",
    "RANDOM_INT": lambda a: f"cast(floor({a[0]} + rand() * ({a[1]} - {a[0]} + 1)) as int)",
    # regular expressions
    "REGEXP_LIKE": _regexp_like,
    "REGEXP_SUBSTR": _regexp_substr,
    "REGEXP_INSTR": _regexp_instr,
    "REGEXP_REPLACE": _regexp_replace,
    # text
    "CHARINDEX": lambda a: f"locate(lower({a[0]}), lower({a[1]}){', ' + a[2] if len(a) > 2 else ''})",
    "CLEAN_STRING": lambda a: f"trim(regexp_replace(regexp_replace({a[0]}, '\\\\p{{Cntrl}}', ' '), '\\\\s+', ' '))",
    "CONCAT": lambda a: "concat(" + ", ".join(f"coalesce(cast({x} as string), '')" for x in a) + ")",
    "FORMAT": lambda a: f"q_format(cast({a[0]} as string), {a[1]})",
    "LEN": lambda a: f"length({a[0]})",
    "LENGTH": lambda a: f"length({a[0]})",
    "LPAD": lambda a: f"lpad({a[0]}, {a[1]}, {a[2] if len(a) > 2 else chr(39) + ' ' + chr(39)})",
    "RPAD": lambda a: f"rpad({a[0]}, {a[1]}, {a[2] if len(a) > 2 else chr(39) + ' ' + chr(39)})",
    "MASK_EMAIL": lambda a: f"case when {a[0]} is null then null when instr({a[0]}, '@') = 0 then '***@***.com' when instr({a[0]}, '@') <= 3 then concat('*', substring({a[0]}, instr({a[0]}, '@'))) else concat(left({a[0]}, 1), '***', substring({a[0]}, instr({a[0]}, '@') - 1)) end",
    "MASK_PHONE": _last_four("***-***-"),
    "MASK_SSN": _last_four("***-**-"),
    "PATINDEX": _patindex,
    "QUOTENAME": lambda a: _quotename(a),
    "REMOVE_HIDDEN_CHARACTERS": lambda a: _hidden(a),
    "REMOVE_HTML_CHARACTERS": lambda a: f"q_plain_text({a[0]})",
    "STR": lambda a: _str(a),
    "STRING_ESCAPE": lambda a: _escape(a),
    "STUFF": lambda a: f"concat(left({a[0]}, {a[1]} - 1), {a[3]}, substring({a[0]}, {a[1]} + {a[2]}))",
    "TO_STR": lambda a: f"cast({a[0]} as string)",
    # paths
    "PATH_FILENAME": lambda a: f"regexp_extract({a[0]}, '([^/\\\\\\\\]*)$', 1)",
    "PATH_DIRECTORY": lambda a: f"regexp_replace({a[0]}, '[/\\\\\\\\]?[^/\\\\\\\\]*$', '')",
    "PATH_EXTENSION": lambda a: f"regexp_extract({a[0]}, '([.][^./\\\\\\\\]*)$', 1)",
    "PATH_FILENAME_NO_EXT": lambda a: f"regexp_replace(regexp_extract({a[0]}, '([^/\\\\\\\\]*)$', 1), '[.][^.]*$', '')",
    "PATH_CHANGE_EXTENSION": lambda a: f"concat(regexp_replace({a[0]}, '[.][^./\\\\\\\\]*$', ''), case when startswith({a[1]}, '.') then {a[1]} else concat('.', {a[1]}) end)",
    "PATH_COMBINE": lambda a: f"nullif(regexp_replace(concat_ws('/', {', '.join(a)}), '(?<!:)/+', '/'), '')",
}


def _quotename(a: list[str]) -> str:
    d = a[1].strip()[1:-1] if len(a) > 1 else "["
    left, right = {"[": ("[", "]"), "]": ("[", "]"), '"': ('"', '"'), "''": ("''", "''"), "'": ("''", "''"), "\\'": ("\\'", "\\'")}.get(d, (d, d))
    return f"concat('{left}', replace({a[0]}, '{right}', '{right}{right}'), '{right}')"


def _hidden(a: list[str]) -> str:
    if len(a) > 1:
        out = a[0]
        for x in a[1:]:
            out = f"replace({out}, {x}, ' ')"
        return out
    spaces = "[\\\\s\\\\u00A0\\\\u1680\\\\u2000-\\\\u200A\\\\u2028\\\\u2029\\\\u202F\\\\u205F\\\\u3000]"
    gone = "[\\\\u00AD\\\\u200B-\\\\u200F\\\\u2060\\\\uFEFF]"
    return f"regexp_replace(regexp_replace({a[0]}, '{gone}', ''), '{spaces}', ' ')"


def _str(a: list[str]) -> str:
    n, d = _get(a, 1) or "10", _get(a, 2) or "0"
    text = f"cast(round(cast({a[0]} as decimal(38,10)), {d}) as decimal(38,{d if d.isdigit() else 10}))"
    return f"case when length(cast({text} as string)) > {n} then repeat('*', {n}) else lpad(cast({text} as string), {n}, ' ') end"


def _escape(a: list[str]) -> str:
    kind = a[1].strip().strip("'").lower()
    if kind == "json":
        return f"regexp_extract(to_json(struct({a[0]} as v)), '(?s)^\\\\{{\"v\":\"(.*)\"\\\\}}$', 1)"
    return f"replace(replace({_xml_escape(a[0])}, '\"', '&quot;'), '\\'', '&#39;')"


#: Functions that give rows: the Spark SQL text of an array of their values.
TABLE_FUNCTIONS: dict[str, Lowering] = {
    "UNNEST": lambda a: a[0],
    "FLATTEN": lambda a: f"flatten({a[0]})",
    "GENERATE_SERIES": lambda a: f"sequence({', '.join(a)})",
    "STRING_SPLIT": lambda a: f"split({a[0]}, concat('\\\\Q', {a[1]}, '\\\\E'))",
    "NGRAMS": lambda a: f"case when length({a[0]}) >= {a[1]} then transform(sequence(1, length({a[0]}) - {a[1]} + 1), i -> substring({a[0]}, i, {a[1]})) else array() end",
    "NGRAM_TOKENS": lambda a: f"flatten(transform(filter(split(lower(trim({a[0]})), '\\\\s+'), t -> t <> ''), t -> transform(sequence(1, length(t)), i -> substring(concat(' ', t, ' '), i, 3))))",
    "REGEXP_MATCHES": lambda a: f"regexp_extract_all({a[0]}, {_flags(a[1], _get(a, 2))}, 0)",
    "REGEXP_SPLIT_TO_TABLE": lambda a: f"split({a[0]}, {_flags(a[1], _get(a, 2))})",
}

#: Functions the session answers, as literals, before a query runs: files, jobs, errors, tenancy, tags.
SESSION = set("ERROR_LINE ERROR_MESSAGE ERROR_NUMBER ERROR_SEVERITY ERROR_STATE GET_JOB_STATE SET_JOB_STATE ENV CURRENT_TENANT TENANT_ID IS_SANDBOX RELDATE DIRECTORY_EXISTS FILE_CREATED FILE_EXISTS FILE_HASH FILE_LINE_COUNT FILE_MODIFIED FILE_SIZE CONNECTION_PROPERTY GET_TAG_VALUE HAS_TAG REMOTE_DIRECTORY_EXISTS REMOTE_FILE_EXISTS REMOTE_FILE_MODIFIED REMOTE_FILE_SIZE".split())


def lower(name: str, args: list[str]) -> str:
    """The Spark SQL text of a call."""
    up = name.upper()
    if up in LOWERED:
        return LOWERED[up](args)
    if up == "COUNT" and not args:
        return "count(*)"
    return f"{RENAMED.get(up, name)}({', '.join(args)})"


def call(name: str, *args) -> Column:
    """A call as a Column; texts are SQL expressions, other values literals."""

    def text(x) -> str:
        if isinstance(x, str):
            return x
        if x is None:
            return "null"
        if isinstance(x, bool):
            return str(x).lower()
        return repr(x)

    return F.expr(lower(name, [text(a) for a in args]))


# --- functions without an SQL form -------------------------------------------------------------------------------------


def _json_steps(path: str) -> list:
    return [int(i) if i else k.strip('"') for k, i in re.findall(r"\.(\"[^\"]*\"|[^.\[]+)|\[(\d+)\]", path)]


def json_modify(text: str | None, path: str | None, value: str | None) -> str | None:
    """text with the value at a path set, or removed for null."""
    if text is None or path is None:
        return text
    data = json.loads(text)
    steps = _json_steps(path)
    at = data
    for s in steps[:-1]:
        at = at.setdefault(s, {}) if isinstance(at, dict) else at[s]
    last = steps[-1]
    if value is None:
        if isinstance(at, dict):
            at.pop(last, None)
        elif isinstance(last, int) and last < len(at):
            at.pop(last)
    elif isinstance(at, list) and last == len(at):
        at.append(value)
    else:
        at[last] = value
    return json.dumps(data, ensure_ascii=False)


def json_query(text: str | None, path: str | None) -> str | None:
    """The source text of the object or array at a path; null for scalars and missing paths."""
    if text is None or path is None:
        return None
    decoder = json.JSONDecoder()

    def skip(i: int) -> int:
        while i < len(text) and text[i] in " \t\r\n":
            i += 1
        return i

    try:
        i = skip(0)
        for s in _json_steps(path):
            if isinstance(s, int) and text[i] == "[" or isinstance(s, str) and text[i] == "{":
                close, n, found = {"[": "]", "{": "}"}[text[i]], 0, None
                i = skip(i + 1)
                while text[i] != close:
                    key = n
                    if close == "}":
                        key, j = decoder.raw_decode(text, i)
                        i = skip(skip(j) + 1)
                    if key == s:
                        found = i
                        break
                    _, j = decoder.raw_decode(text, i)
                    i = skip(j)
                    if text[i] == ",":
                        i = skip(i + 1)
                    n += 1
                if found is None:
                    return None
                i = found
            else:
                return None
        value, end = decoder.raw_decode(text, i)
    except (ValueError, IndexError):
        return None
    return text[i:end] if isinstance(value, (dict, list)) else None


def xml_query(text: str | None, path: str | None) -> str | None:
    """The XML text of the first element on a path, relative to the document."""
    if text is None or path is None:
        return None
    try:
        root = ET.fromstring(text)
    except ET.ParseError:
        return None
    box = ET.Element("box")
    box.append(root)
    found = box.findall("." + path if path.startswith("/") else path)
    return "".join(ET.tostring(e, encoding="unicode").strip() for e in found) or None


_SMART = {0x2018: "'", 0x2019: "'", 0x201A: "'", 0x201C: '"', 0x201D: '"', 0x201E: '"', 0x2010: "-", 0x2011: "-", 0x2012: "-", 0x2013: "-", 0x2014: "-", 0x2015: "-", 0x2026: "...", 0x2022: "*", 0x00A0: " ", 0x00AD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None}


def plain_text(text: str | None) -> str | None:
    """Character references decoded, typographic characters as ASCII."""
    return None if text is None else html.unescape(text).translate(_SMART)


def format_value(text: str | None, pattern: str | None) -> str | None:
    """A number or date in a .NET standard or custom format (invariant culture)."""
    if text is None or pattern is None:
        return None
    m = re.fullmatch(r"([NnFfCcPpDdEeXxGg])(\d*)", pattern)
    try:
        number = float(text)
    except ValueError:
        number = None
    if number is not None:
        if m:
            kind, digits = m[1].upper(), m[2]
            d = int(digits) if digits else 2
            if kind == "N":
                return f"{number:,.{d}f}"
            if kind == "F":
                return f"{number:.{d}f}"
            if kind == "C":
                return f"{'-' if number < 0 else ''}¤{abs(number):,.{d}f}".replace("¤", "$")
            if kind == "P":
                return f"{number * 100:,.{d}f} %"
            if kind == "D":
                return f"{int(number):0{int(digits or 1)}d}"
            if kind == "E":
                base, _, power = f"{number:.{int(digits or 6)}E}".partition("E")
                return f"{base}E{power[0]}{int(power[1:]):03d}"
            if kind == "X":
                return f"{int(number):0{int(digits or 1)}{m[1]}}"
            return text
        whole, _, fraction = pattern.partition(".")
        least, most = fraction.count("0"), len(re.findall("[0#]", fraction))
        body = f"{abs(number):{',' if ',' in whole else ''}.{most}f}"
        if most > least:
            head, _, tail = body.partition(".")
            tail = tail[:least] + tail[least:].rstrip("0")
            body = head + ("." + tail if tail else "")
        zeros = whole.count("0")
        head, dot, tail = body.partition(".")
        return ("-" if number < 0 else "") + head.zfill(zeros) + dot + tail
    stamp = pd.Timestamp(text)
    names = {"yyyy": "%Y", "yy": "%y", "MMMM": "%B", "MMM": "%b", "MM": "%m", "dddd": "%A", "ddd": "%a", "dd": "%d", "HH": "%H", "hh": "%I", "mm": "%M", "ss": "%S", "tt": "%p"}
    out = {"d": "MM/dd/yyyy", "D": "dddd, dd MMMM yyyy", "t": "HH:mm", "T": "HH:mm:ss", "s": "yyyy-MM-ddTHH:mm:ss"}.get(pattern, pattern)

    def part(m: re.Match) -> str:
        t = m[0]
        if t in names:
            return stamp.strftime(names[t])
        single = {"M": stamp.month, "d": stamp.day, "H": stamp.hour, "h": stamp.hour % 12 or 12, "m": stamp.minute, "s": stamp.second}
        return f"{stamp.microsecond:06d}"[: len(t)] if t[0] == "f" else str(single.get(t, t))

    return re.sub(r"yyyy|yy|M{1,4}|d{1,4}|HH?|hh?|mm?|ss?|tt|f{1,6}", part, out)


def _texts(f: Callable, n: int):
    """A batched text function of n arguments."""
    if n == 1:

        @F.pandas_udf("string")
        def one(a: pd.Series) -> pd.Series:
            return pd.Series([f(x) for x in a], dtype=object)

        return one
    if n == 2:

        @F.pandas_udf("string")
        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        return two

    @F.pandas_udf("string")
    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([f(x, y, z) for x, y, z in zip(a, b, c, strict=True)], dtype=object)

    return three


def similarity_of(a: str, b: str, mode: str) -> float:
    """The score of two texts, as fuzzy.similarity."""
    x, y = a.lower(), b.lower()
    if mode == "JAROWINKLER":
        return fuzzy.jaro_winkler(x, y)
    if mode == "LEVENSHTEIN" or mode == "TOKENSORT":
        if mode == "TOKENSORT":
            x, y = " ".join(sorted(x.split())), " ".join(sorted(y.split()))
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return 1 - row[-1] / max(len(x), len(y)) if x or y else 1.0
    grams = lambda s: {f" {s} "[i : i + 3] for i in range(max(1, len(s)))}
    p, q = (grams(x), grams(y)) if mode == "TRIGRAM" else (set(x.split()), set(y.split()))
    return len(p & q) / len(p | q) if p | q else 1.0


def register(spark: SparkSession) -> None:
    """Register the q_ functions that lowered texts call."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series, mode: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else similarity_of(x, y, m.upper()) for x, y, m in zip(a, b, mode, strict=True)], dtype="float64")

    spark.udf.register("q_similarity", score)
    spark.udf.register("q_metaphone", fuzzy.metaphone)
    spark.udf.register("q_dmetaphone", fuzzy.dmetaphone)
    spark.udf.register("q_dmetaphone_alt", fuzzy.dmetaphone_alt)
    spark.udf.register("q_json_modify", _texts(json_modify, 3))
    spark.udf.register("q_json_query", _texts(json_query, 2))
    spark.udf.register("q_xml_query", _texts(xml_query, 2))
    spark.udf.register("q_plain_text", _texts(plain_text, 1))
    spark.udf.register("q_format", _texts(format_value, 2))
    spark.udf.register("q_normalize", _texts(_normalize_text, 2))


def _normalize_text(text: str | None, mode: str | None) -> str | None:
    """fuzzy.normalize, on one text."""
    if text is None:
        return None
    clean = " ".join(re.sub(r"[\x00-\x08\x0e-\x1f\x7f]", "", text.lower()).split())
    mode = (mode or "").upper()
    if not mode:
        return clean
    if mode == "EMAIL":
        return text.lower().strip()
    if mode == "PHONE":
        d = re.sub(r"\D", "", text)
        return d[1:] if len(d) == 11 and d[0] == "1" else d
    bare = re.sub(r"[.,;:'\"#]", " " if mode == "ADDRESS" else "", clean)
    if mode == "COMPANY":
        out = re.sub(r"\b(?:the|a|an)\b", " ", re.sub(r"\s*&\s*", " and ", bare))
        for _ in range(2):
            out = re.sub(rf"\s+(?:{fuzzy.COMPANY_SUFFIXES.replace(' ', '|')})$", "", out.strip())
    elif mode == "PERSON":
        out = re.sub(rf"\b(?:{fuzzy.PERSON_WORDS.replace(' ', '|')})\b", " ", bare)
    elif mode == "ADDRESS":
        out = re.sub(rf"\b(?:{fuzzy.UNIT_WORDS.replace(' ', '|')})\s+\w+", " ", bare)
        out = " ".join(fuzzy.ADDRESS_WORDS.get(w, w) for w in out.split())
    else:
        raise ValueError(f"normalize mode {mode!r}")
    return " ".join(out.split())


def file_function(name: str, args: list) -> object:
    """FILE_ and DIRECTORY_ functions, on the driver."""
    path = str(args[0])
    match name.upper():
        case "FILE_EXISTS":
            return int(os.path.isfile(path))
        case "DIRECTORY_EXISTS":
            return int(os.path.isdir(path))
        case "FILE_SIZE":
            return os.path.getsize(path)
        case "FILE_CREATED":
            return pd.Timestamp(os.path.getctime(path), unit="s").to_pydatetime()
        case "FILE_MODIFIED":
            return pd.Timestamp(os.path.getmtime(path), unit="s").to_pydatetime()
        case "FILE_HASH":
            with open(path, "rb") as f:
                return hashlib.file_digest(f, "sha256").hexdigest()
        case "FILE_LINE_COUNT":
            with open(path, "rb") as f:
                return sum(1 for _ in f) - int(args[1] if len(args) > 1 else 0)
    raise ValueError(name)
