"""The wide owner table and the cards for requested keys."""

from __future__ import annotations

from rollbook.operators import contacts, directory, episodes, flows, profile, ranks, rollup
from rollbook.plans.base import (
    CURRENT_SQL,
    DOCS_SQL,
    EDGES_SQL,
    current_keys,
    dated,
    owner_docs,
    query,
    with_snap,
)
from rollbook.plans.diff_queries import TOTALS_SELECT
from rollbook.plans.directory_queries import NAMES_SQL, _hidden, _names
from rollbook.plans.document_queries import FLAGS_SQL
from rollbook.plans.rank_queries import RANKS_SELECT, RANKS_SQL, RUNS_SQL, _enrichment
from rollbook.plans.source_queries import TEXT_SQL, key_texts
from rollbook.session import materialise

_EDGE_TAIL = EDGES_SQL[EDGES_SQL.index(",\nedges AS") :]
PROFILE_SQL = f"""{RANKS_SQL}{_EDGE_TAIL},{FLAGS_SQL},{RUNS_SQL},
rk AS ({RANKS_SELECT}), ft AS ({TOTALS_SELECT}),
tr AS (SELECT owner, CAST(sum(acquired) AS BIGINT) AS acquired, CAST(sum(harvested_cross_owner) AS BIGINT) AS harvested,
  arg_min(inventory, period) AS first_inventory, arg_max(inventory, period) AS last_inventory FROM roll GROUP BY owner),
ep AS (SELECT owner, count(*) FILTER (WHERE duration <= 2) AS n_abbreviated, count(*) FILTER (WHERE duration >= 3) AS n_standard, count(*) FILTER (WHERE duration <= 2) / count(*) AS abbrev_rate
  FROM runs GROUP BY owner),
mb AS (SELECT owner, brand AS mailbox, confidence AS mailbox_confidence FROM (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY CASE confidence WHEN 'high' THEN 0 ELSE 1 END, doc_no) AS rn FROM fl) WHERE rn = 1),
li AS (SELECT owner, count(*) AS inventory FROM latest GROUP BY owner)"""


@query(
    "owner_profile",
    with_snap(
        PROFILE_SQL,
        """SELECT owner, coalesce(li.inventory, 0) AS inventory, coalesce(f.title, 'Unknown owner (' || owner || ')') AS title, f.alias, f.website, f.city, f.state,
        coalesce(tr.acquired, 0) AS acquired, coalesce(tr.harvested, 0) AS harvested, CASE WHEN tr.owner IS NOT NULL THEN coalesce(tr.harvested / nullif(tr.acquired, 0), 0.0) END AS opportunism,
        coalesce(last_inventory - first_inventory, 0) AS delta, CASE WHEN tr.owner IS NOT NULL THEN coalesce((last_inventory - first_inventory) / nullif(first_inventory, 0) * 100, 0.0) END AS pct,
        coalesce(working_count, 0) AS working_count, coalesce(match_count, 0) AS match_count, match_rate, b_under_1m, b_1_3m, b_3_12m, b_1_2y, b_2_5y, b_5y_plus, median_age_months,
        inbound_transfer, inbound_harvest, inbound_first_assign, inbound_reactivate, outbound_transfer, outbound_disconnect, outbound_to_spare,
        n_abbreviated, n_standard, abbrev_rate, mailbox, mailbox_confidence,
        '#' || inv_rank || ' of ' || inv_total AS inv_label, '#' || opp_rank || ' of ' || opp_total AS opp_label, '#' || growth_rank || ' of ' || growth_total AS growth_label,
        '#' || match_rank || ' of ' || match_total AS match_label, '#' || age_rank || ' of ' || age_total AS age_label, coalesce(li.inventory, 0) <= 14 AS is_small
        FROM (SELECT owner FROM li UNION SELECT owner FROM fdoc) s LEFT JOIN li USING (owner) LEFT JOIN fdoc f USING (owner) LEFT JOIN rk USING (owner) LEFT JOIN tr USING (owner)
        LEFT JOIN enr USING (owner) LEFT JOIN ft USING (owner) LEFT JOIN ep USING (owner) LEFT JOIN mb USING (owner) WHERE owner NOT IN (SELECT owner FROM hid)""",
    ),
)
def _(spark, d):
    """Six tables are read from the snapshots, so these are written once and shared."""
    rows, when = dated(spark, d)
    rows = materialise(rows, "profile-snapshot")
    rolled = materialise(rollup.owner_period_rollup(rows, when), "profile-rollup")
    latest = rollup.latest_snapshot(rows, when)
    enriched = materialise(_enrichment(spark, d), "profile-enrichment")
    docs = owner_docs(spark, d)
    return profile.owner_profile(
        rollup.owner_inventory(latest),
        directory.first_docs(docs),
        _hidden(spark, d),
        ranks.ranks(ranks.measures(rolled, enriched, 1000, 10, 500)),
        ranks.owner_trajectory(rolled),
        enriched,
        flows.flow_totals(flows.flow_edges(rows, when)),
        episodes.episode_summary(episodes.disconnect_runs(rows)),
        contacts.flag_dedupe(contacts.mailbox_flags(docs)),
    )


@query(
    "key_status_card",
    f"""WITH{CURRENT_SQL},{TEXT_SQL},{DOCS_SQL},{NAMES_SQL}
SELECT request_id, substr(n.phone, 1, 3) || '-' || substr(n.phone, 4) AS formatted, CASE status WHEN 1 THEN 'WORKING' WHEN 2 THEN 'TRANSIT' ELSE 'DISCONN' END AS status,
  sub_owner, c.owner, c.owner = lpad(CAST(p_size % 25 AS VARCHAR), 2, '0') AS owner_match, coalesce(name, c.owner) AS owner_name, strftime(changed_at, '%b %Y') AS last_change
FROM nrm n JOIN cur c USING (phone) LEFT JOIN nm ON nm.owner = c.owner""",
)
def _(spark, d):
    return profile.key_status_card(key_texts(spark, d), current_keys(spark, d), _names(spark, d), None)
