"""The text rules once more, as DuckDB SQL for the oracles."""

from __future__ import annotations

from .functions import fields as R
from .functions.text import TYPE_STATUSES


def case(key: str, values: list) -> str:
    """A CASE that deals the values by key; valid in Spark and in DuckDB."""
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {quoted(v)}" for i, v in enumerate(values)) + " END"


def listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def clean(c: str) -> str:
    x = rf"regexp_replace(coalesce({c}, ''), '^\s+|\s+$', '', 'g')"
    return f"(CASE WHEN lower({x}) IN ('nan', 'none', 'null') THEN '' ELSE {x} END)"


def normal(c: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(lower({clean(c)}), '[^\p{{L}}\p{{N}}_\s.\-]', '', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')"


def identifier(c: str) -> str:
    return f"upper(regexp_replace({clean(c)}, '[^A-Za-z0-9]+', '', 'g'))"


def alnum(c: str) -> str:
    return f"regexp_replace(lower({clean(c)}), '[^a-z0-9]+', '', 'g')"


def person(c: str) -> str:
    return f"array_to_string(list_sort(regexp_extract_all(lower({clean(c)}), '[a-zà-öø-ÿ0-9]+')), ' ')"


def type_status(c: str) -> str:
    return "CASE " + " ".join(rf"WHEN regexp_matches(lower({clean(c)}), '\b{s}\b') THEN '{s}'" for s in TYPE_STATUSES) + f" ELSE {normal(c)} END"


def date_part(c: str) -> str:
    plain = rf"regexp_replace(replace(regexp_replace(regexp_replace({clean(c)}, '(\d)(st|nd|rd|th)\b', '\1', 'gi'), '\s+', ' ', 'g'), ',', ''), '^[ .]+|[ .]+$', '', 'g')"
    forms = "['%Y-%m-%d', '%Y/%m/%d', '%d.%m.%Y', '%d/%m/%Y', '%d-%m-%Y', '%d %b %Y', '%d %B %Y', '%b %d %Y', '%B %d %Y']"
    return rf"coalesce(strftime(try_strptime({plain}, {forms}), '%Y-%m-%d'), CASE WHEN regexp_full_match({plain}, '\d{{4}}(-\d{{2}})?') THEN {plain} END, {normal(c)})"


def event_date(c: str) -> str:
    left, right = (f"trim(string_split({clean(c)}, '/')[{k}])" for k in (1, 2))
    both = rf"len(string_split({clean(c)}, '/')) = 2 AND regexp_matches({left}, '\b\d{{4}}\b') AND regexp_matches({right}, '\b\d{{4}}\b')"
    return f"CASE WHEN {both} THEN {date_part(left)} || '/' || {date_part(right)} ELSE {date_part(c)} END"


def number(c: str) -> str:
    return f"TRY_CAST({clean(c)} AS DOUBLE)"


def normal_value(field: str, c: str) -> str:
    decimal = rf"regexp_replace(printf('%.8f', {number(c)}), '\.?0+$', '')"
    return f"""CASE WHEN {field} = 'catalogNumber' THEN {identifier(c)} WHEN {field} = 'eventDate' THEN {event_date(c)} WHEN {field} = 'recordedBy' THEN {person(c)}
        WHEN {field} = 'typeStatus' THEN {type_status(c)} WHEN {field} IN ({listed(R.COORDINATES)}) AND {number(c)} IS NOT NULL THEN {decimal} ELSE {normal(c)} END"""


def exact(field: str, pred: str, gold: str, p: str, g: str) -> str:
    """`p` and `g` are the normal forms."""
    return f"""CAST(CASE WHEN {field} IN ({listed(R.COORDINATES)}) AND {number(pred)} IS NOT NULL AND {number(gold)} IS NOT NULL THEN abs({number(pred)} - {number(gold)}) <= 0.0001 ELSE {p} = {g} END AS INT)"""


def bag(c: str) -> str:
    return f"list_filter(string_split(replace({c}, '/', ' '), ' '), lambda x: x <> '')"


def bag_f1(p: str, g: str) -> str:
    common = f"coalesce(list_sum(list_transform(list_distinct({p}), lambda t: least(len(list_filter({p}, lambda x: x = t)), len(list_filter({g}, lambda x: x = t))))), 0)"
    return f"CASE WHEN len({p}) = 0 AND len({g}) = 0 THEN 1.0 WHEN len({p}) = 0 OR len({g}) = 0 THEN 0.0 ELSE 2.0 * {common} / (len({p}) + len({g})) END"


def proxy(value: str, text: str) -> str:
    """Of normal forms: null without a value, 1 if the text holds it, else the share of its words."""
    v, t = bag(value), bag(text)
    return f"CASE WHEN {value} = '' THEN NULL WHEN {text} = '' THEN 0.0 WHEN contains({text}, {value}) THEN 1.0 ELSE len(list_intersect(list_distinct({v}), {t})) / len(list_distinct({v})) END"


def looked_up(table: dict, key: str, default: str) -> str:
    number_or_text = lambda v: str(v) if isinstance(v, float) else f"'{v}'"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {number_or_text(v)}" for k, v in table.items()) + f" ELSE {default} END"


def component_type(c: str) -> str:
    snake = rf"replace(trim(regexp_replace(replace(lower({clean(c)}), ':', ' '), '\s+', ' ', 'g')), ' ', '_')"
    return looked_up(R.LABEL_ALIASES, snake, snake)


def role(kind: str) -> str:
    return looked_up(R.ROLES, kind, "'other'")


def plausible(c: str) -> str:
    key = identifier(c)
    return f"(length({key}) BETWEEN 5 AND 24 AND regexp_matches({key}, '[A-Z]') AND regexp_matches({key}, '[0-9]'))"


def matching_ratio(source: str, left: str, right: str, name: str = "ratio") -> str:
    """CTEs that give `name` (a, b, ratio) for the distinct pairs of non-blank texts of a source: longest block first, then both sides of it."""
    sizes = "list_transform(range(1, len(x) + 1), lambda i: len(list_filter(range(1, len(x) - i + 2), lambda n: contains(y, substr(x, i, n)))))"
    sized = f"(SELECT *, {sizes} AS sizes FROM {name}_parts WHERE x <> '' AND y <> '')"
    best = f"(SELECT *, list_max(sizes) AS m, list_position(sizes, list_max(sizes)) AS i FROM {sized})"
    return f"""{name}_parts(a, b, x, y) AS (SELECT DISTINCT {left}, {right}, {left}, {right} FROM {source}
      UNION ALL SELECT a, b, unnest([substr(x, 1, i - 1), substr(x, i + m)]), unnest([substr(y, 1, instr(y, substr(x, i, m)) - 1), substr(y, instr(y, substr(x, i, m)) + m)]) FROM {best} WHERE m > 0),
    {name} AS (SELECT DISTINCT {left} AS a, {right} AS b, coalesce(2.0 * m / (length({left}) + length({right})), CASE WHEN {left} = {right} THEN 1.0 ELSE 0.0 END) AS ratio
      FROM {source} LEFT JOIN (SELECT a, b, CAST(sum(m) AS DOUBLE) AS m FROM {best} GROUP BY 1, 2) s ON s.a = {left} AND s.b = {right})"""
