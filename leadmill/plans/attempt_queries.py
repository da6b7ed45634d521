"""Queries of planned and executed searches, and the SQL they are held against."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadmill.operators import attempts
from leadmill.operators.attempts import ENDPOINT, MODES, MOST_CALLS, PROVIDER, PlanSettings
from leadmill.operators.registry_search import REPEATABLE
from leadmill.plans.lead_queries import _DIGITS, _EV, _HOST_OF, _MAIL_OF, _N1, NOW, _evidence
from leadmill.plans.variant_queries import _legal, _written
from leadmill.sources.domain import oracle, table

#: Everything that is off by default, for the searches that a batch makes.
DEEP = PlanSettings(strict_address=True, legal_name=True, email_domain_filter=True)


def _profiles(s: SparkSession, d: str, settings: PlanSettings) -> DataFrame:
    return attempts.search_profiles(table(s, d, "leads"), table(s, d, "municipalities"), settings)


def _plans(s: SparkSession, d: str) -> DataFrame:
    """The plans of all three modes over the same profiles."""
    profiles = _profiles(s, d, PlanSettings())
    each = [attempts.planned(profiles, mode).withColumn("search_mode", F.lit(mode)) for mode in MOST_CALLS]
    return reduce(lambda a, b: a.unionByName(b), each).withColumn("searched", F.array_join("searched", "|"))


def _executed(s: SparkSession, d: str) -> DataFrame:
    """A batch in delivery mode: the searches at place p find the lead's registry records at p; every fifth lead has been searched before."""
    plans = attempts.planned(_profiles(s, d, DEEP), "delivery", DEEP)
    kinds = F.element_at(F.array(*map(F.lit, MODES)), (F.col("candidate_pos") - 1).cast("int") % len(MODES) + 1)
    outcomes = _evidence(s, d).select("lead_id", kinds.alias("mode"), "score")
    before = plans.where("lead_id % 5 = 0").select("lead_id", "signature", F.lit(PROVIDER).alias("provider"), F.lit(REPEATABLE[0]).alias("reason"), (F.lit(NOW) - F.make_dt_interval(F.lit(0), (F.col("lead_id") % 4 * 12).cast("int"))).alias("at"))
    return attempts.executed(plans, outcomes, before, NOW).select("lead_id", "place", "mode", "signature", "found", "status")


def _json(limit: int, **own: str) -> str:
    given = {"limit": f"'{limit}'", "status.id.in": "'2'", "address.state.in": "state", "address.municipality.in": "municipality", **{f"{k}.in".replace("_", "."): v for k, v in own.items()}}
    return "'{' || concat_ws(',', " + ", ".join(f"CASE WHEN coalesce({v}, '') <> '' THEN '\"{k}\":' || CAST(to_json({v}) AS VARCHAR) END" for k, v in sorted(given.items())) + ") || '}'"


_PROFILES = f"""pf AS (SELECT lead_id, leads.business_name, leads.state, municipality, nullif({_DIGITS('postal_code')}, '') AS postal, nullif(neighborhood, '') AS neighborhood,
  CASE WHEN m.area IS NULL OR m.area = a THEN a END AS area, coalesce(nullif({_MAIL_OF('email')}, ''), {_HOST_OF('website')}) AS domain, CASE WHEN nullif({_MAIL_OF('email')}, '') IS NOT NULL THEN 'email_domain' WHEN {_HOST_OF('website')} IS NOT NULL THEN 'website_domain_as_email_domain' END AS domain_source,
  {', '.join(f'{_written("nv." + c)} AS {c}' for c in ('alias', 'names', 'legal'))}
  FROM (SELECT *, substr(coalesce({_DIGITS('phone')}, {_DIGITS('whatsapp')}), -10, 2) AS a FROM leads) leads JOIN nv ON leads.business_name = nv.business_name AND leads.category = nv.category LEFT JOIN municipalities m ON leads.city = m.city AND leads.state = m.state)"""


def _plan_steps(name: str, mode: str, s: PlanSettings) -> str:
    joined = lambda c: f"array_to_string({c}, ',')"
    strict = "(CASE WHEN len(alias) > 0 THEN alias ELSE names END)[1:2]"
    wide, deep = mode != "cheap", mode == "delivery"
    filtering = {"emails_domain": "domain"} if s.email_domain_filter else {}
    made = {
        "email_domain": (f"{wide} AND domain IS NOT NULL", "'emails.domain.in'", "[domain]", _json(10, emails_domain="domain")),
        "alias": ("len(alias) > 0", "'alias.in'", "alias", _json(10, alias=joined("alias"))),
        "names": (f"{wide} AND len(names) > 0", "'names.in'", "names", _json(10, names=joined("names"), phones_area="area")),
        "zip_fallback": (f"{deep} AND postal IS NOT NULL AND state IS NOT NULL", "CAST(NULL AS VARCHAR)", "[postal]", _json(20, address_zip="postal")),
        "address": (f"{deep and s.strict_address} AND postal IS NOT NULL AND neighborhood IS NOT NULL AND len(alias) + len(names) > 0", "CASE WHEN len(alias) > 0 THEN 'alias.in' ELSE 'names.in' END", strict,
                    _json(10, alias=f"CASE WHEN len(alias) > 0 THEN {joined(strict)} END", names=f"CASE WHEN len(alias) = 0 THEN {joined(strict)} END", address_zip="postal", address_district="neighborhood", **filtering)),
        "company_name": (f"{deep and s.legal_name} AND len(legal) > 0 AND {_legal(_N1('business_name'))}", "'company.name.in'", "legal", _json(10, company_name=joined("legal"))),
    }
    rows = " UNION ALL ".join(f"SELECT lead_id, {i} AS ord, '{k}' AS mode, {q} AS query_param, array_to_string({v}, '|') AS searched, {p} AS params, {str(MODES[k]).lower()} AS conditional, {'domain_source' if k == 'email_domain' else 'CAST(NULL AS VARCHAR)'} AS domain_source FROM pf WHERE {w}" for i, (k, (w, q, v, p)) in enumerate(made.items()))
    return f"""{name} AS (SELECT * EXCLUDE (ord), sha256(concat_ws('|', '{PROVIDER}', '{ENDPOINT}', mode, coalesce(query_param, ''), params)) AS signature FROM (SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY ord) AS place
  FROM (SELECT * FROM ({rows}) QUALIFY row_number() OVER (PARTITION BY lead_id, params ORDER BY ord) = 1)) WHERE place <= {MOST_CALLS[mode]})"""


def _made_steps() -> str:
    out = [f"oc AS (SELECT lead_id, ({list(MODES)})[(candidate_pos - 1) % {len(MODES)} + 1] AS mode, max(score) AS found FROM sc GROUP BY ALL)",
           "rd AS (SELECT p.*, found, p.lead_id % 5 = 0 AND p.lead_id % 4 < 2 AS waits FROM p LEFT JOIN oc ON p.lead_id = oc.lead_id AND p.mode = oc.mode)"]
    for i, k in enumerate(MODES):
        earlier = " UNION ALL ".join(f"SELECT lead_id, found FROM k{j} WHERE status = 'executed'" for j in range(i)) or "SELECT 0 AS lead_id, 0 AS found WHERE false"
        out.append(f"n{i} AS (SELECT rd.*, NOT conditional OR coalesce(best, 0) < 50 AS needed FROM rd LEFT JOIN (SELECT lead_id, max(found) AS best FROM ({earlier}) GROUP BY lead_id) b ON rd.lead_id = b.lead_id WHERE mode = '{k}')")
        out.append(f"k{i} AS (SELECT n.*, CASE WHEN NOT needed THEN 'not_needed' WHEN n.lead_id > f THEN 'skipped_duplicate' WHEN waits THEN 'skipped_recent' ELSE 'executed' END AS status FROM n{i} n LEFT JOIN (SELECT signature, min(lead_id) AS f FROM n{i} WHERE needed AND NOT waits GROUP BY signature) x ON n.signature = x.signature)")
    return ",\n".join(out)


_BEFORE = oracle("", "leads", "registry", "municipalities").rstrip() + ",\n" + _EV + ",\n" + _PROFILES + ",\n"
QUERIES = {"r2_attempt_plans": _plans, "r4_executed_searches": _executed}
ORACLE_SQL = {
    "r2_attempt_plans": _BEFORE + ",\n".join(_plan_steps(m, m, PlanSettings()) for m in MOST_CALLS) + "\n" + " UNION ALL ".join(f"SELECT *, '{m}' AS search_mode FROM {m}" for m in MOST_CALLS),
    "r4_executed_searches": _BEFORE + _plan_steps("p", "delivery", DEEP) + ",\n" + _made_steps() + "\n" + " UNION ALL ".join(f"SELECT lead_id, place, mode, signature, found, status FROM k{i}" for i in range(len(MODES))),
}
