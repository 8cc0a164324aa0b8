"""Rule cascade, gap filling, exports and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollbook.operators import rules, validate
from rollbook.plans.base import (
    ADJ_INPUT_CTES,
    ADJUSTED_CTES,
    CURRENT_SQL,
    GAP_SQL,
    PHONE_RULES,
    RAW_CURRENT_SQL,
    RENAME_RULES,
    STATUS_RULES,
    adjust_input,
    adjusted,
    cascade_sql,
    current_keys,
    overrides,
    query,
    table,
    top_suffix,
    wide_suffix,
)
from rollbook.session import materialise, scratch_path
from rollbook.sources import lines, rule_files, sinks

PASS_SQL = f"WITH{ADJ_INPUT_CTES},{cascade_sql('inp')}\n"
FIELDS = ("phone", "status", "date", "template", "sub_owner")


@query("parse_adjust_line", f"WITH{ADJ_INPUT_CTES}\nSELECT * FROM inp")
def _(spark, d):
    return adjust_input(spark, d)


@query("rule_phone_pattern", PASS_SQL + "SELECT phone, status, date, template, sub_owner FROM p1b")
def _(spark, d):
    return rules.apply_phone_rules(adjust_input(spark, d), PHONE_RULES).select(*FIELDS)


@query("wildcard_rule_join", PASS_SQL + "SELECT h AS rule_no, count(*) AS n FROM p1 GROUP BY 1")
def _(spark, d):
    found = rules.wildcard_rule_join(adjust_input(spark, d), PHONE_RULES)
    return found.groupBy("rule_no").agg(F.count("*").alias("n"))


@query("rule_rename_owner", PASS_SQL + "SELECT phone, sub_owner FROM p2")
def _(spark, d):
    out = rules.apply_phone_rules(adjust_input(spark, d), PHONE_RULES)
    return rules.apply_rename_rules(out, RENAME_RULES).select("phone", "sub_owner")


@query("rule_status_override", PASS_SQL + "SELECT phone, status, sub_owner FROM p3")
def _(spark, d):
    out = rules.apply_phone_rules(adjust_input(spark, d), PHONE_RULES)
    out = rules.apply_rename_rules(out, RENAME_RULES)
    return rules.apply_status_rules(out, STATUS_RULES).select("phone", "status", "sub_owner")


@query(
    "rule_individual",
    f"""WITH{ADJ_INPUT_CTES}
SELECT phone, coalesce(o.code, i.sub_owner) AS sub_owner FROM inp i LEFT JOIN (SELECT * FROM ovr WHERE code <> '') o USING (phone)""",
)
def _(spark, d):
    return rules.apply_overrides(adjust_input(spark, d), overrides(spark, d)).select("phone", "sub_owner")


@query(
    "exact_override_join",
    f"""WITH{ADJ_INPUT_CTES}
SELECT o.code, count(*) AS n FROM inp JOIN ovr o USING (phone) WHERE o.code <> '' GROUP BY 1""",
)
def _(spark, d):
    out = rules.apply_overrides(adjust_input(spark, d), overrides(spark, d))
    hit = out.where(F.col("sub_owner").startswith("OV"))
    return hit.groupBy(F.col("sub_owner").alias("code")).agg(F.count("*").alias("n"))


@query("gap_fill", f"WITH{ADJ_INPUT_CTES},{GAP_SQL}\nSELECT * FROM filled")
def _(spark, d):
    return rules.gap_fill(adjust_input(spark, d), 0, top_suffix(spark, d), "key")


@query("adjust_snapshot", f"WITH{ADJUSTED_CTES}\nSELECT * FROM adj")
def _(spark, d):
    return adjusted(spark, d)


def _exported(spark, rows, to_lines, name):
    """The lines as they stand in the files of an export, in the order of the phones."""
    path = scratch_path(spark, name)
    # a line begins with its phone, so it is its own key
    sinks.write_ordered_text(to_lines(rows), path, "value")
    return sinks.read_ordered_text(spark, path).select("value")


@query(
    "sink_fixed_width",
    f"""WITH{ADJUSTED_CTES}
SELECT substr(phone, 1, 3) || '-' || substr(phone, 4, 3) || '-' || substr(phone, 7) || '  ,' || rpad(substr(status, 1, 7), 7, ' ') || ' ,'
  || rpad(date, 8, ' ') || ',' || rpad(template, 2, ' ') || ',' || rpad(sub_owner, 5, ' ') AS value FROM adj""",
)
def _(spark, d):
    return _exported(spark, adjusted(spark, d), sinks.fixed_width_lines, "fixed")


@query(
    "sink_csv_variable",
    f"WITH{ADJUSTED_CTES}\nSELECT phone || ',' || status || ',' || date || ',' || template || ',' || sub_owner AS value FROM adj",
)
def _(spark, d):
    return _exported(spark, adjusted(spark, d), sinks.variable_lines, "variable")


# Ours are the adjusted rows, theirs the rows before the last pass, without the AVAIL rows of 888.
VALIDATE_CTES = ADJUSTED_CTES + """,
ours AS (SELECT * FROM adj WHERE NOT (sub_owner = '' AND phone LIKE '877%')),
theirs AS (SELECT * FROM p3 WHERE NOT (sub_owner = '' AND phone LIKE '888%')),
al AS (SELECT coalesce(o.phone, t.phone) AS phone, o.sub_owner AS o_code, t.sub_owner AS t_code,
  CASE WHEN t.phone IS NULL THEN 'only_ours' WHEN o.phone IS NULL THEN 'only_theirs' ELSE
    coalesce(nullif(concat_ws('+', CASE WHEN trim(o.status) <> trim(t.status) THEN 'status' END, CASE WHEN trim(o.date) <> trim(t.date) THEN 'date' END,
      CASE WHEN trim(o.template) <> trim(t.template) THEN 'template' END, CASE WHEN trim(o.sub_owner) <> trim(t.sub_owner) THEN 'sub_owner' END), ''), 'equal') END AS finding
  FROM ours o FULL OUTER JOIN theirs t ON o.phone = t.phone)"""


def _found(spark, d):
    full = rules.gap_fill(adjust_input(spark, d), 0, top_suffix(spark, d), "key")
    three = rules.apply_phone_rules(full, PHONE_RULES)
    three = rules.apply_status_rules(rules.apply_rename_rules(three, RENAME_RULES), STATUS_RULES)
    ours = rules.apply_overrides(three, overrides(spark, d))
    blank = F.col("sub_owner") == ""
    ours = ours.where(~(blank & F.col("phone").startswith("877")))
    theirs = three.where(~(blank & F.col("phone").startswith("888")))
    return validate.difference(validate.align(ours, theirs))


@query("validation_diff", f"WITH{VALIDATE_CTES}\nSELECT finding, count(*) AS n FROM al GROUP BY 1")
def _(spark, d):
    return validate.field_report(_found(spark, d))


@query(
    "validation_code_pairs",
    f"WITH{VALIDATE_CTES}\nSELECT t_code AS their_code, o_code AS our_code, count(*) AS n FROM al WHERE t_code <> o_code GROUP BY 1, 2",
)
def _(spark, d):
    return validate.code_pair_report(_found(spark, d))


@query(
    "validation_verdict",
    f"""WITH{VALIDATE_CTES}
SELECT count(*) AS total, count(*) FILTER (WHERE finding = 'equal') AS equal,
  count(*) FILTER (WHERE finding NOT IN ('equal', 'only_ours', 'only_theirs')) AS differing,
  count(*) FILTER (WHERE finding = 'only_ours') AS only_ours, count(*) FILTER (WHERE finding = 'only_theirs') AS only_theirs,
  count(*) FILTER (WHERE finding = 'sub_owner' AND o_code = 'OV013') AS expected,
  count(*) FILTER (WHERE finding NOT IN ('equal', 'only_ours', 'only_theirs') AND NOT (finding = 'sub_owner' AND o_code = 'OV013')) = 0 AS passed FROM al""",
)
def _(spark, d):
    return validate.verdict(_found(spark, d), "OV013")


# --- rule files -----------------------------------------------------------------------

# An override file of one line per part: every tenth repeats the phone before it, every
# thirteenth goes back, some are malformed.
OVERRIDE_FILE_SQL = """
f AS (SELECT p_partkey AS line_no, CASE WHEN p_partkey % 17 = 3 THEN '800123' WHEN p_partkey % 19 = 4 THEN '80012345X7,AB123'
    WHEN p_partkey % 23 = 5 THEN lpad(CAST(p_partkey AS VARCHAR), 10, '8') || ',TOOLONG'
    WHEN p_partkey % 13 = 6 THEN lpad(CAST(greatest(p_partkey - 40, 0) AS VARCHAR), 10, '8') || ',AB0' || p_size % 10 || '1'
    WHEN p_partkey % 10 = 7 THEN lpad(CAST(p_partkey - 1 AS VARCHAR), 10, '8') || ',AB001'
    ELSE ' ' || lpad(CAST(p_partkey AS VARCHAR), 10, '8') || ' ,AB001' END AS value FROM part),
v AS (SELECT line_no, trim(string_split(trim(value), ',')[1]) AS phone, trim(string_split(trim(value), ',')[2]) AS code FROM f),
w AS (SELECT *, coalesce(NOT regexp_full_match(phone, '[0-9]{10,}') OR length(code) <> 5, true) AS bad FROM v),
r AS (SELECT *, max(CASE WHEN NOT bad THEN phone END) OVER (ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS running,
  row_number() OVER (PARTITION BY phone, bad ORDER BY line_no) AS nth FROM w),
k AS (SELECT phone, min(line_no) AS kept_line FROM r WHERE NOT bad AND nth = 1 AND (running IS NULL OR phone >= running) GROUP BY phone),
j AS (SELECT r.line_no, r.phone, r.code, CASE WHEN bad THEN 'bad' WHEN r.line_no > kept_line THEN 'duplicate' WHEN r.line_no = kept_line THEN 'kept' ELSE 'sequence' END AS verdict
  FROM r LEFT JOIN k ON k.phone = r.phone)"""


def _override_file(spark, d):
    k = F.col("p_partkey")

    def eights(number):
        return F.lpad(number.cast("string"), 10, "8")

    code = F.concat(F.lit(",AB0"), (F.col("p_size") % 10).cast("string"), F.lit("1"))
    value = (
        F.when(k % 17 == 3, "800123")
        .when(k % 19 == 4, "80012345X7,AB123")
        .when(k % 23 == 5, F.concat(eights(k), F.lit(",TOOLONG")))
        .when(k % 13 == 6, F.concat(eights(F.greatest(k - 40, F.lit(0))), code))
        .when(k % 10 == 7, F.concat(eights(k - 1), F.lit(",AB001")))
        .otherwise(F.concat(F.lit(" "), eights(k), F.lit(" ,AB001")))
    )
    return table(spark, d, "part").select(k.alias("line_no"), value.alias("value"))


@query("load_rules", f"WITH{OVERRIDE_FILE_SQL}\nSELECT line_no, phone, code, verdict FROM j")
def _(spark, d):
    return rule_files.judge_overrides(_override_file(spark, d))


@query("load_rules_summary", f"WITH{OVERRIDE_FILE_SQL}\nSELECT verdict, count(*) AS n FROM j GROUP BY 1")
def _(spark, d):
    judged = rule_files.judge_overrides(_override_file(spark, d))
    return judged.groupBy("verdict").agg(F.count("*").alias("n"))


@query(
    "load_phone_rules",
    """SELECT p_partkey AS rule_no, lpad(CAST(p_partkey % 10000 AS VARCHAR), 6, '8') || '****' AS pattern,
    CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN '' ELSE 'UNAVAIL' END AS status,
    CAST(NULL AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS template, CAST(NULL AS VARCHAR) AS code FROM part
    WHERE p_size % 7 NOT IN (0, 1) AND p_partkey < (SELECT max(p_partkey) FROM part) - 10""",
)
def _(spark, d):
    """One rule line per part, some of them comments or too short, and an early FILE END."""
    part = table(spark, d, "part")
    end = part.agg(F.max("p_partkey") - 10).scalar()
    k = F.col("p_partkey")
    stem = F.lpad((k % 10000).cast("string"), 6, "8")
    pattern = F.concat(F.substring(stem, 1, 3), F.lit("-"), F.substring(stem, 4, 3), F.lit("-****"))
    status = F.when(F.col("p_size") % 3 == 0, "*").when(F.col("p_size") % 3 == 1, "").otherwise("UNAVAIL")
    value = (
        F.when(k == end, "FILE END")
        .when(F.col("p_size") % 7 == 0, F.concat(F.lit("<> "), pattern))
        .when(F.col("p_size") % 7 == 1, F.concat(F.substring(pattern, 1, 9), F.lit(",*,*,*,*")))
        .otherwise(F.concat(pattern, F.lit(","), status, F.lit(",*,*,*   <> since "), F.col("p_brand")))
    )
    return rule_files.load_phone_rules(part.select(k.alias("line_no"), value.alias("value")))


def _written(spark, lines, name):
    """Lines (line_no, value) as a text file in the shared folder, in their order."""
    path = scratch_path(spark, name)
    lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("value").write.text(path)
    return rule_files.read_rule_file(spark, path)


def _literal_lines(spark, rules):
    """Rules as lines of a rule file: '*' keeps a value and nothing clears it."""
    text = [",".join("*" if v is None else v for v in r) + "   <> as given" for r in rules]
    return spark.createDataFrame(list(enumerate(["<> head", *text, "FILE END", "800-*******,BAD,*,*,*"])), "line_no long, value string")


@query("adjust_from_files", f"WITH{ADJUSTED_CTES}\nSELECT * FROM adj")
def _(spark, d):
    """All four rule files are written as text, read, loaded and applied. The loaded rules are
    written once: the plan of the cascade reads them, not the files."""

    def loaded(load, lines, name):
        return materialise(load(_written(spark, lines, f"{name}-lines")), name)

    phone = loaded(rule_files.load_phone_rules, _literal_lines(spark, PHONE_RULES), "phone-rules")
    rename = loaded(rule_files.load_rename_rules, _literal_lines(spark, RENAME_RULES), "rename-rules")
    status = loaded(rule_files.load_status_rules, _literal_lines(spark, STATUS_RULES), "status-rules")
    exact = overrides(spark, d).where("code <> ''").select(
        F.col("phone").cast("long").alias("line_no"), F.concat_ws(",", "phone", "code").alias("value")
    )
    exact = loaded(rule_files.load_overrides, exact, "overrides")
    full = rules.gap_fill(adjust_input(spark, d), 0, top_suffix(spark, d), "key")
    return rules.adjust_snapshot(full, phone, rename, status, exact)


# One rule per part: the pattern keeps the last digits of the part's suffix, and every third
# part's rule fixes other positions. Patterns repeat, and the first of those counts.
MANY_SQL = """
many AS (SELECT p_partkey AS rule_no, CASE p_partkey % 3 WHEN 0 THEN '8**' || format('{:07d}', p_partkey // 2) WHEN 1 THEN '***' || right(format('{:07d}', p_partkey), 7)
    ELSE '8******' || right(format('{:07d}', p_partkey), 3) END AS pattern FROM part)"""


@query(
    "wildcard_many_rules",
    f"""WITH{ADJ_INPUT_CTES},{MANY_SQL}
SELECT phone, (SELECT min(rule_no) FROM many WHERE inp.phone LIKE replace(pattern, '*', '_')) AS rule_no FROM inp""",
)
def _(spark, d):
    k = F.col("p_partkey")
    digits = wide_suffix(k)
    pattern = (
        F.when(k % 3 == 0, F.concat(F.lit("8**"), wide_suffix(F.floor(k / 2))))
        .when(k % 3 == 1, F.concat(F.lit("***"), F.right(digits, F.lit(7))))
        .otherwise(F.concat(F.lit("8******"), F.right(digits, F.lit(3))))
    )
    many = table(spark, d, "part").select(k.alias("rule_no"), pattern.alias("pattern"))
    return rules.wildcard_rule_join(adjust_input(spark, d), many).select("phone", "rule_no")


@query(
    "reject_counts",
    f"""WITH{CURRENT_SQL},{RAW_CURRENT_SQL}
SELECT count(*) AS lines, count(*) FILTER (WHERE key % 50 = 0) AS too_few_fields, count(*) FILTER (WHERE key % 50 = 3) AS blank_key_or_code,
  count(*) FILTER (WHERE key % 50 = 4) AS bad_number, count(*) FILTER (WHERE key % 50 IN (1, 5)) AS unknown_status,
  count(*) FILTER (WHERE key % 50 = 2) AS bad_date FROM rawc""",
)
def _(spark, d):
    from rollbook.plans.base import raw_lines

    return lines.reject_counts(raw_lines(current_keys(spark, d)))
