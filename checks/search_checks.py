"""Linked decisions over stored predictions; SQL redoes the predictions, every gate and what follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.spec import check
from fieldform import scale
from fieldform.operators import cohorts
from fieldform.plans import registry, search
from fieldform.plans.panels import blocks_panel, search_panel
from fieldform.plans.search import Configuration, RateFolds, Scope
from fieldform.plans.store import ResultStore

SURFACES = ("turf", "dirt")
YEARS = (2000, 2001)
SCOPES = {"A": (1200, 1200), "B": (1000, 1400), "C": (1000, 2600)}
OUTER = {2000: (1998, 1999), 2001: (1998, 1999, 2000)}
FAMILIES = {"career": (), "distance": ("near", "regime"), "course": ("course_distance",)}
STRENGTHS = (40.0, 20.0, 10.0, 6.0, 3.0, 1.0)  # from the simplest, which trusts the prior most
CONFIGURATIONS = [
    Configuration(family, f"{family}_{rank}", rank, {"blocks": blocks, "strength": s})
    for family, blocks in FAMILIES.items() for rank, s in enumerate(STRENGTHS, 1)
]
_made: dict[tuple, object] = {}


def once(name: str, spark, sf: str, build):
    """What several queries share in a session, each written where it was made."""
    key = (name, spark.sparkContext.applicationId, sf)
    if key not in _made:
        _made[key] = build()
    return _made[key]


def store(spark, sf) -> ResultStore:
    return once("store", spark, sf, lambda: ResultStore(spark, sf))


def scope_search(spark, sf) -> dict[str, search.ScopeSearch]:
    def build():
        return {
            s: search.scope_search(
                search_panel(spark, sf), Scope(s, 1200, 1200), {f: Scope(s, *d) for f, d in SCOPES.items()}, YEARS, search.predict_rates, store(spark, sf)
            )
            for s in SURFACES
        }

    return once("scopes", spark, sf, build)


def routing(spark, sf) -> search.Routing:
    def build():
        held = reduce(DataFrame.unionByName, [found.predictions for found in scope_search(spark, sf).values()])
        return search.staged_routing(search_panel(spark, sf), SURFACES, YEARS, search.predict_rates, store(spark, sf), override=(1200, held))

    return once("routing", spark, sf, build)


def nested(spark, sf) -> dict[str, search.Nested]:
    def build():
        panel = search_panel(spark, sf)
        return {s: search.nested_search(RateFolds(cohorts.select_cohort(panel, s)), OUTER, CONFIGURATIONS, ResultStore(spark, f"{sf}#{s}"), "career") for s in SURFACES}

    return once("nested", spark, sf, build)


def by_surface(parts: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("surface", F.lit(s)) for s, df in parts.items()])


def gate_sql(src: str, out: str) -> str:
    """Decisions of all groups of ``src`` (grp, incumbent, candidate, contest_id, block, brier, log_loss)."""
    return f"""
{out}_s AS MATERIALIZED (SELECT grp, any_value(incumbent) AS incumbent, candidate, avg(brier) AS mb, avg(log_loss) AS ml, count(*) AS contests FROM {src} GROUP BY grp, candidate),
{out}_b AS MATERIALIZED (SELECT grp, any_value(incumbent) AS incumbent, first(candidate ORDER BY mb, ml, candidate) AS point_best, any_value(contests) AS contests FROM {out}_s GROUP BY grp),
{out}_d AS MATERIALIZED (SELECT a.grp, a.candidate, a.block, a.brier - r.brier AS db FROM {src} a JOIN {out}_b b ON b.grp = a.grp
  JOIN {src} r ON r.grp = a.grp AND r.candidate = b.point_best AND r.contest_id = a.contest_id),
{out}_m AS MATERIALIZED (SELECT grp, candidate, avg(db) AS m, count(*) AS n FROM {out}_d GROUP BY grp, candidate),
{out}_e AS MATERIALIZED (SELECT grp, candidate, m, CASE WHEN count(*) < 2 THEN 'inf'::DOUBLE ELSE sqrt(count(*) / (count(*) - 1.0) * sum(s * s) / (n * n)) END AS se
  FROM (SELECT d.grp, d.candidate, d.block, m.m, m.n, sum(d.db - m.m) AS s FROM {out}_d d JOIN {out}_m m ON m.grp = d.grp AND m.candidate = d.candidate GROUP BY ALL)
  GROUP BY grp, candidate, m, n),
{out} AS MATERIALIZED (SELECT b.*, e.m AS mean_brier_delta, e.se AS se_brier_delta, e.m <= e.se + 1e-15 AS incumbent_retained,
  CASE WHEN e.m <= e.se + 1e-15 THEN b.incumbent ELSE b.point_best END AS winner
  FROM {out}_b b JOIN {out}_e e ON e.grp = b.grp AND e.candidate = b.incumbent)"""


def rate(q: str, block: str, strength: str = "6.0") -> str:
    return f"(({block}_top3 + {q} * {strength}) / ({block}_starts + {strength}))"


LOSS = (
    "avg(pow(p - label, 2)) AS brier, "
    "avg(-(label * ln(least(greatest(p, 1e-12), 1 - 1e-12)) + (1 - label) * ln(1 - least(greatest(p, 1e-12), 1 - 1e-12)))) AS log_loss"
)
NAMES = "list_filter([CASE WHEN m & 1 > 0 THEN 'near' END, CASE WHEN m & 2 > 0 THEN 'regime' END, CASE WHEN m & 4 > 0 THEN 'course_distance' END], lambda x: x IS NOT NULL)"
ROWS = """sc AS MATERIALIZED (SELECT p.contest_id, p.contest_date, p.subject_id, p.label, p.surface, p.distance_m, year(p.contest_date) AS y, p.field_size,
  p.turn_direction, p.career_starts, p.career_top3, b.* EXCLUDE (contest_id, subject_id) FROM panel p JOIN blocks b ON b.contest_id = p.contest_id AND b.subject_id = p.subject_id
  WHERE p.surface IN ('turf', 'dirt') AND p.field_size >= 8 AND p.career_starts >= 3)"""
# All subsets m of the three blocks for each family, the gate of every step that may come up, and the walk through them.
SEARCH = f"""WITH {ROWS},
straight AS MATERIALIZED (SELECT * FROM sc WHERE turn_direction <> 'straight' AND distance_m BETWEEN 1000 AND 2600),
years AS (SELECT unnest([2000, 2001]) AS y),
fam(family, lo, hi) AS (VALUES ('A', 1200, 1200), ('B', 1000, 1400), ('C', 1000, 2600)),
fam_prior AS MATERIALIZED (SELECT f.family, s.surface, e.y, avg(s.label) AS q FROM fam f JOIN straight s ON s.distance_m BETWEEN f.lo AND f.hi JOIN years e ON s.y < e.y GROUP BY ALL),
fam_pred AS MATERIALIZED (SELECT s.surface, f.family, m, f.family || '_' || CASE WHEN m = 0 THEN 'F0' ELSE array_to_string({NAMES}, '_') END AS candidate,
  s.contest_id, s.contest_date, s.subject_id, s.label, s.distance_m,
  ({rate('q', 'career')} + (m & 1) * {rate('q', 'near')} + (m >> 1 & 1) * {rate('q', 'regime')} + (m >> 2 & 1) * {rate('q', 'course_distance')}) / (1 + bit_count(m)) AS p
  FROM straight s JOIN fam_prior f ON f.surface = s.surface AND f.y = s.y, (SELECT unnest(range(0, 8))::INT AS m) WHERE s.distance_m = 1200),
fam_loss AS MATERIALIZED (SELECT surface, family, m, candidate, contest_id, min(contest_date) AS block, count(*) AS rows, {LOSS} FROM fam_pred GROUP BY surface, family, m, candidate, contest_id),
steps AS (SELECT s.m, k.k, s.m | (1 << k.k) AS m2 FROM (SELECT unnest(range(0, 8))::INT AS m) s, (SELECT unnest(range(0, 3))::INT AS k) k WHERE s.m < (1 << k.k)),
step_src AS MATERIALIZED (SELECT l.surface || '|' || l.family || '|' || t.m || '|' || t.k AS grp, o.candidate AS incumbent, l.candidate, l.contest_id, l.block, l.brier, l.log_loss
  FROM steps t JOIN fam_loss l ON l.m IN (t.m, t.m2) JOIN (SELECT DISTINCT surface, family, m, candidate FROM fam_loss) o
  ON o.surface = l.surface AND o.family = l.family AND o.m = t.m),
{gate_sql('step_src', 'step_gate')},
walk AS (SELECT DISTINCT surface, family, 0 AS k, 0 AS m, NULL::VARCHAR AS grp FROM fam_loss
  UNION ALL SELECT w.surface, w.family, w.k + 1, CASE WHEN g.incumbent_retained THEN w.m ELSE w.m | (1 << w.k) END, g.grp
  FROM walk w JOIN step_gate g ON g.grp = w.surface || '|' || w.family || '|' || w.m || '|' || w.k WHERE w.k < 3),
ends AS MATERIALIZED (SELECT DISTINCT surface, family, m FROM walk WHERE k = 3 UNION SELECT DISTINCT surface, 'A', 0 FROM walk),
final_src AS MATERIALIZED (SELECT l.surface AS grp, 'A_F0' AS incumbent, l.* EXCLUDE (surface) FROM fam_loss l JOIN ends e ON e.surface = l.surface AND e.family = l.family AND e.m = l.m),
{gate_sql('final_src', 'final_gate')}"""


@check(
    "scope_search_gates",
    "surface:s family:s block:s candidate:s incumbent:s contests:i mean_brier_delta:f se_brier_delta:f accepted:i",
    f"""{SEARCH}
---- /*recursive*/
SELECT w.surface, w.family, (['near', 'regime', 'course_distance'])[w.k] AS block, n.candidate, g.incumbent, g.contests, g.mean_brier_delta, g.se_brier_delta,
  CAST(NOT g.incumbent_retained AS INT) AS accepted
FROM walk w JOIN step_gate g ON g.grp = w.grp JOIN (SELECT DISTINCT grp, candidate FROM step_src) n ON n.grp = g.grp AND n.candidate <> g.incumbent WHERE w.k > 0""",
)
def _(spark, sf):
    return by_surface({s: found.gates for s, found in scope_search(spark, sf).items()})


@check(
    "scope_search_finalists",
    "surface:s family:s candidate:s lo:i hi:i blocks:s macro_brier:f macro_log_loss:f is_winner:i",
    f"""{SEARCH}
---- /*recursive*/
SELECT s.grp AS surface, x.family, s.candidate, f.lo, f.hi, array_to_string({NAMES}, ',') AS blocks, s.mb AS macro_brier, s.ml AS macro_log_loss,
  CAST(s.candidate = g.winner AS INT) AS is_winner
FROM final_gate_s s JOIN final_gate g ON g.grp = s.grp JOIN (SELECT DISTINCT grp, candidate, family, m FROM final_src) x ON x.grp = s.grp AND x.candidate = s.candidate
JOIN fam f ON f.family = x.family""",
)
def _(spark, sf):
    return by_surface({s: found.finalists for s, found in scope_search(spark, sf).items()})


ROUTE = f"""{SEARCH},
bands(lo, hi) AS (VALUES (1000, 1400), (1401, 2000), (2001, 2600)),
band_prior AS MATERIALIZED (SELECT b.lo, b.hi, s.surface, e.y, avg(s.label) AS q FROM (FROM bands UNION ALL VALUES (1000, 2600)) b(lo, hi)
  JOIN straight s ON s.distance_m BETWEEN b.lo AND b.hi JOIN years e ON s.y < e.y GROUP BY ALL),
route_pred AS MATERIALIZED (SELECT s.surface, b.lo, b.hi, c.candidate, s.contest_id, s.contest_date, s.subject_id, s.label, s.distance_m,
  CASE c.candidate WHEN 'G0' THEN {rate('w.q', 'career')}
    WHEN 'G3' THEN ({rate('w.q', 'career')} + {rate('w.q', 'near')} + {rate('w.q', 'regime')} + {rate('w.q', 'course_distance')}) / 4
    ELSE ({rate('o.q', 'career')} + {rate('o.q', 'near')} + {rate('o.q', 'regime')} + {rate('o.q', 'course_distance')}) / 4 END AS p
  FROM straight s JOIN bands b ON s.distance_m BETWEEN b.lo AND b.hi JOIN band_prior w ON w.surface = s.surface AND w.y = s.y AND w.lo = 1000 AND w.hi = 2600
  JOIN band_prior o ON o.surface = s.surface AND o.y = s.y AND o.lo = b.lo AND o.hi = b.hi, (VALUES ('G0'), ('G3'), ('R3')) c(candidate)),
route_loss AS MATERIALIZED (SELECT surface, lo, hi, candidate, contest_id, min(contest_date) AS block, min(distance_m) AS distance_m, {LOSS} FROM route_pred GROUP BY surface, lo, hi, candidate, contest_id),
global_src AS (SELECT surface AS grp, 'G0' AS incumbent, * FROM route_loss WHERE candidate IN ('G0', 'G3')), {gate_sql('global_src', 'global_gate')},
whole_src AS (SELECT surface AS grp, 'G0' AS incumbent, * FROM route_loss), {gate_sql('whole_src', 'whole_gate')},
band_src AS (SELECT l.surface || '|' || l.lo AS grp, g.winner AS incumbent, l.* FROM route_loss l JOIN global_gate g ON g.grp = l.surface AND l.candidate IN (g.winner, 'R3')), {gate_sql('band_src', 'band_gate')},
band_route AS MATERIALIZED (SELECT g.grp AS surface, b.lo, b.hi, COALESCE(x.winner, g.winner) AS model_id FROM global_gate g CROSS JOIN bands b LEFT JOIN band_gate x ON x.grp = g.grp || '|' || b.lo),
held AS MATERIALIZED (SELECT p.* FROM fam_pred p JOIN final_gate g ON g.grp = p.surface AND g.winner = p.candidate),
over_src AS MATERIALIZED (SELECT l.surface AS grp, 'held' AS incumbent, 'route' AS candidate, l.contest_id, l.block, l.brier, l.log_loss FROM route_loss l
    JOIN band_route r ON r.surface = l.surface AND r.lo = l.lo AND r.model_id = l.candidate WHERE l.distance_m = 1200
  UNION ALL SELECT l.surface, 'held', 'held', l.contest_id, l.block, l.brier, l.log_loss FROM fam_loss l JOIN final_gate g ON g.grp = l.surface AND g.winner = l.candidate),
{gate_sql('over_src', 'over_gate')}"""


@check(
    "staged_routing_decisions",
    "surface:s gate:s lo:f hi:f incumbent:s point_best:s incumbent_retained:i winner:s contests:i mean_brier_delta:f se_brier_delta:f",
    f"""{ROUTE}
---- /*recursive*/
SELECT *, CAST(keep AS INT) AS incumbent_retained FROM (
SELECT grp AS surface, 'global' AS gate, NULL AS lo, NULL AS hi, incumbent, point_best, incumbent_retained AS keep, winner, contests, mean_brier_delta, se_brier_delta FROM global_gate
UNION ALL SELECT grp, 'whole', NULL, NULL, incumbent, point_best, incumbent_retained, winner, contests, mean_brier_delta, se_brier_delta FROM whole_gate
UNION ALL SELECT split_part(grp, '|', 1), 'band', b.lo, b.hi, incumbent, point_best, incumbent_retained, winner, contests, mean_brier_delta, se_brier_delta
  FROM band_gate JOIN bands b ON b.lo::VARCHAR = split_part(grp, '|', 2)
UNION ALL SELECT grp, 'override', 1200, 1200, incumbent, point_best, incumbent_retained, winner, contests, mean_brier_delta, se_brier_delta FROM over_gate)""",
)
def _(spark, sf):
    return routing(spark, sf).decisions


@check(
    "staged_routing_routes",
    "surface:s lo:i hi:i model_id:s is_override:i",
    f"""{ROUTE}
---- /*recursive*/
SELECT *, 0 AS is_override FROM band_route UNION ALL SELECT grp, 1200, 1200, 'held_1200', 1 FROM over_gate WHERE winner = 'held'""",
)
def _(spark, sf):
    return routing(spark, sf).routes


@check(
    "staged_routing_predictions",
    "contest_id:i subject_id:i model_id:s p:f",
    f"""{ROUTE}
---- /*recursive*/
SELECT p.contest_id, p.subject_id, r.model_id, p.p FROM route_pred p JOIN band_route r ON r.surface = p.surface AND r.lo = p.lo AND r.model_id = p.candidate
WHERE NOT (p.distance_m = 1200 AND p.surface IN (SELECT grp FROM over_gate WHERE winner = 'held'))
UNION ALL SELECT contest_id, subject_id, 'held_1200', p FROM held WHERE surface IN (SELECT grp FROM over_gate WHERE winner = 'held')""",
)
def _(spark, sf):
    return routing(spark, sf).predictions


THROUGH = "2000-12-31"  # the last day that production models learn from


def production(spark, sf) -> registry.Production:
    def build():
        blocks_panel(spark, sf)  # whole rows are fingerprinted, so the searches may read of them too
        routes, specs = registry.compile_routing(routing(spark, sf).routes, registry.held_specs(scope_search(spark, sf)))
        root = scale.new_folder(spark, "registry")
        registry.refit(blocks_panel(spark, sf), routes, specs, registry.RateFits(), root, THROUGH)
        return registry.current(spark, root, registry.RateFits(), routes)

    return once("production", spark, sf, build)


REFIT = f"""{ROUTE},
route_table AS MATERIALIZED (SELECT surface, lo, hi, surface || '_' || model_id || CASE WHEN model_id = 'R3' THEN '_' || lo || '_' || hi ELSE '' END AS model_id,
    CASE WHEN model_id = 'R3' THEN lo ELSE 1000 END AS slo, CASE WHEN model_id = 'R3' THEN hi ELSE 2600 END AS shi, CASE WHEN model_id = 'G0' THEN 0 ELSE 7 END AS m, FALSE AS exact FROM band_route
  UNION ALL SELECT o.grp, 1200, 1200, o.grp || '_held_1200', f.lo, f.hi, x.m, TRUE FROM over_gate o JOIN final_gate g ON g.grp = o.grp
  JOIN (SELECT DISTINCT grp, candidate, family, m FROM final_src) x ON x.grp = g.grp AND x.candidate = g.winner JOIN fam f ON f.family = x.family WHERE o.winner = 'held'),
fitted AS MATERIALIZED (SELECT r.model_id, r.surface, r.slo, r.shi, r.m, count(*) AS train_rows, count(DISTINCT contest_id) AS train_contests, avg(label) AS q,
    min(contest_date) AS trained_from, max(contest_date) AS trained_through, count(*) FILTER (contest_date = last_day) AS parity_rows
  FROM (SELECT DISTINCT model_id, surface, slo, shi, m FROM route_table) r
  JOIN (SELECT t.model_id, s.*, max(contest_date) OVER (PARTITION BY t.model_id) AS last_day FROM straight s
    JOIN (SELECT DISTINCT model_id, surface, slo, shi FROM route_table) t ON t.surface = s.surface AND s.distance_m BETWEEN t.slo AND t.shi
    WHERE s.contest_date <= DATE '{THROUGH}') s ON s.model_id = r.model_id GROUP BY ALL)"""


@check(
    "model_registry",
    "model_id:s surface:s lo:i hi:i blocks:s prior:f train_rows:i train_contests:i trained_from:d trained_through:d parity_rows:i max_abs_error:f",
    f"""{REFIT}
---- /*recursive*/
SELECT model_id, surface, slo AS lo, shi AS hi, array_to_string({NAMES}, ',') AS blocks, q AS prior, train_rows, train_contests, trained_from, trained_through,
  parity_rows, 0 AS max_abs_error FROM fitted""",
)
def _(spark, sf):
    return production(spark, sf).models


@check(
    "registry_scores",
    "contest_id:i subject_id:i p_nonmarket:f route:s model_id:s reason:s",
    f"""{REFIT},
head AS MATERIALIZED (SELECT contest_id, any_value(contest_date) AS day, any_value(surface) AS surface, any_value(distance_m) AS distance_m
  FROM panel GROUP BY contest_id HAVING any_value(field_size) >= 8 AND any_value(turn_direction) <> 'straight'),
placed AS MATERIALIZED (SELECT h.contest_id, h.day, COALESCE(e.model_id, b.model_id) AS model_id FROM head h
  LEFT JOIN route_table e ON e.exact AND e.surface = h.surface AND e.lo = h.distance_m
  LEFT JOIN route_table b ON NOT b.exact AND b.surface = h.surface AND h.distance_m BETWEEN b.lo AND b.hi),
judged AS MATERIALIZED (SELECT p.contest_id, p.subject_id, p.career_starts, p.career_top3, k.* EXCLUDE (contest_id, subject_id), f.q, f.m, f.model_id AS fitted_id,
  CASE WHEN f.model_id IS NULL THEN 'no_route' WHEN f.trained_through >= l.day THEN 'trained_too_late' WHEN p.career_starts < 3 THEN 'too_few_starts' END AS reason
  FROM panel p JOIN blocks k ON k.contest_id = p.contest_id AND k.subject_id = p.subject_id LEFT JOIN placed l ON l.contest_id = p.contest_id LEFT JOIN fitted f ON f.model_id = l.model_id)
---- /*recursive*/
SELECT contest_id, subject_id, reason, CASE WHEN reason IS NULL THEN fitted_id ELSE '' END AS model_id,
  CASE WHEN reason IS NULL THEN 'nonmarket-shadow' ELSE 'market-only' END AS route,
  CASE WHEN reason IS NULL THEN ({rate('q', 'career')} + (m & 1) * {rate('q', 'near')} + (m >> 1 & 1) * {rate('q', 'regime')} + (m >> 2 & 1) * {rate('q', 'course_distance')}) / (1 + bit_count(m)) END AS p_nonmarket
FROM judged""",
)
def _(spark, sf):
    return registry.score(production(spark, sf), blocks_panel(spark, sf), refuse=False)


_CONFIGURATIONS = ", ".join(f"('{c.family}', '{c.name}', {c.complexity_rank}, {float(c.settings['strength'])})" for c in CONFIGURATIONS)
NESTED = f"""WITH {ROWS},
folds AS MATERIALIZED (SELECT s.surface, e.y AS fold, count(*) AS train_rows, count(DISTINCT contest_id) AS train_contests, count(DISTINCT contest_date) AS train_dates, avg(label) AS q
  FROM sc s JOIN (SELECT unnest([1998, 1999, 2000, 2001]) AS y) e ON s.y < e.y GROUP BY ALL),
conf(family, candidate, complexity_rank, k) AS (VALUES {_CONFIGURATIONS}),
conf_pred AS MATERIALIZED (SELECT s.surface, s.y, c.*, s.contest_id, s.contest_date, s.subject_id, s.label,
  CASE c.family WHEN 'career' THEN {rate('f.q', 'career', 'c.k')} WHEN 'distance' THEN ({rate('f.q', 'career', 'c.k')} + {rate('f.q', 'near', 'c.k')} + {rate('f.q', 'regime', 'c.k')}) / 3
    ELSE ({rate('f.q', 'career', 'c.k')} + {rate('f.q', 'course_distance', 'c.k')}) / 2 END AS p
  FROM sc s JOIN folds f ON f.surface = s.surface AND f.fold = s.y, conf c),
conf_loss AS MATERIALIZED (SELECT surface, y, family, candidate, complexity_rank, contest_id, min(contest_date) AS block, count(*) AS rows, {LOSS}
  FROM conf_pred GROUP BY surface, y, family, candidate, complexity_rank, contest_id),
inner_years(o, i) AS (VALUES (2000, 1998), (2000, 1999), (2001, 1998), (2001, 1999), (2001, 2000)),
tune_src AS MATERIALIZED (SELECT surface || '|' || o || '|' || family AS grp, NULL::VARCHAR AS incumbent, l.* FROM conf_loss l JOIN inner_years ON i = y),
{gate_sql('tune_src', 'tune')},
tuned AS MATERIALIZED (SELECT split_part(s.grp, '|', 1) AS surface, split_part(s.grp, '|', 2)::INT AS outer_year, split_part(s.grp, '|', 3) AS family, s.candidate, c.complexity_rank,
  s.mb, s.ml, e.m, e.se, e.m <= e.se + 1e-15 AS near FROM tune_s s JOIN tune_e e ON e.grp = s.grp AND e.candidate = s.candidate JOIN conf c ON c.candidate = s.candidate),
picked AS MATERIALIZED (SELECT surface, outer_year, family, first(candidate ORDER BY complexity_rank, mb, ml, candidate) AS configuration FROM tuned WHERE near GROUP BY ALL),
family_src AS MATERIALIZED (SELECT l.surface AS grp, 'career' AS incumbent, l.family AS candidate, l.contest_id, l.block, l.brier, l.log_loss FROM conf_loss l
  JOIN picked k ON k.surface = l.surface AND k.outer_year = l.y AND k.configuration = l.candidate),
{gate_sql('family_src', 'family_gate')}"""


@check(
    "nested_search_tuning",
    "surface:s outer_year:i family:s candidate:s complexity_rank:i macro_brier:f macro_log_loss:f mean_brier_delta:f se_brier_delta:f within_brier:i is_selected:i",
    f"""{NESTED}
----
SELECT t.*, mb AS macro_brier, ml AS macro_log_loss, m AS mean_brier_delta, se AS se_brier_delta, CAST(near AS INT) AS within_brier,
  CAST(t.candidate = k.configuration AS INT) AS is_selected
FROM tuned t JOIN picked k ON k.surface = t.surface AND k.outer_year = t.outer_year AND k.family = t.family""",
)
def _(spark, sf):
    return by_surface({s: found.tuning for s, found in nested(spark, sf).items()})


@check(
    "nested_search_folds",
    "surface:s fold:i train_rows:i train_contests:i train_dates:i scored_rows:i prior:f",
    f"""{NESTED}
----
SELECT f.*, q AS prior, (SELECT count(*) FROM sc s WHERE s.surface = f.surface AND s.y = f.fold) AS scored_rows FROM folds f""",
)
def _(spark, sf):
    return by_surface({s: found.folds for s, found in nested(spark, sf).items()})


@check(
    "nested_search_predictions",
    "contest_id:i subject_id:i outer_year:i candidate:s configuration:s p:f",
    f"""{NESTED}
----
SELECT p.contest_id, p.subject_id, p.y AS outer_year, p.family AS candidate, k.configuration, p.p FROM conf_pred p
JOIN picked k ON k.surface = p.surface AND k.outer_year = p.y AND k.configuration = p.candidate""",
)
def _(spark, sf):
    return by_surface({s: found.predictions for s, found in nested(spark, sf).items()})


@check(
    "nested_search_decision",
    "surface:s incumbent:s point_best:s incumbent_retained:i winner:s contests:i mean_brier_delta:f se_brier_delta:f",
    f"""{NESTED}
----
SELECT grp AS surface, * EXCLUDE (incumbent_retained), CAST(incumbent_retained AS INT) AS incumbent_retained FROM family_gate""",
)
def _(spark, sf):
    return by_surface({s: found.decision for s, found in nested(spark, sf).items()})
