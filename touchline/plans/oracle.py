"""The same queries as SQL for DuckDB, on common table expressions shared between them."""

from __future__ import annotations

from touchline.plans import rules as RU


def _values(rows, names: str) -> str:
    one = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({names})"


_pair = lambda r: r or (None, None)
_ORDINAL = "{0} || CASE WHEN {0} % 100 BETWEEN 10 AND 20 THEN 'th' WHEN {0} % 10 = 1 THEN 'st' WHEN {0} % 10 = 2 THEN 'nd' WHEN {0} % 10 = 3 THEN 'rd' ELSE 'th' END"
RULE_ROWS = [(t, a, z, n, *_pair(u), *_pair(p), *_pair(q), *_pair(d)) for t, a, z, n, u, p, q, d in RU.RULES]
RANGES = "up_lo, up_hi, playoff_lo, playoff_hi, po_down_lo, po_down_hi, down_lo, down_hi"

CTE = {
    "rules": f"SELECT {', '.join(f'{c}::BIGINT AS {c}' for c in ('tier, from_year, to_year, total_clubs, ' + RANGES).split(', '))} FROM {_values(RULE_ROWS, 'tier, from_year, to_year, total_clubs, ' + RANGES)}",
    "q": """SELECT l_suppkey AS club_id, (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) + 1993 AS season_end_year,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS rev FROM lineitem GROUP BY 1, 2""",
    "mean": "SELECT season_end_year, (sum(rev) // count(*))::BIGINT AS mean FROM q GROUP BY 1",
    "strong": """SELECT club_id, season_end_year, (rev - mean) * CASE club_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 10 ELSE 30 END + mean * ((club_id * 37) % 10) AS strength
        FROM q JOIN mean USING (season_end_year) WHERE rev * 10 >= mean * 7""",
    "tiers": "SELECT *, ntile(5) OVER (PARTITION BY season_end_year ORDER BY strength DESC, club_id)::BIGINT AS tier FROM strong",
    "career": """SELECT club_id, season_end_year, tier, row_number() OVER (PARTITION BY season_end_year, tier ORDER BY strength DESC, club_id)::BIGINT AS position,
        count(*) OVER (PARTITION BY season_end_year, tier)::BIGINT AS n_clubs FROM tiers""",
    "judged": """SELECT *, CASE WHEN position = 1 THEN 'Champions' WHEN position = 2 THEN 'Promoted' WHEN position IN (3, 4) THEN 'Play-off Promoted'
        WHEN position BETWEEN n_clubs - 1 AND n_clubs THEN 'Relegated' ELSE 'Stayed' END AS status FROM career""",
    "nexts": """SELECT j.*, n.tier AS next_tier FROM judged j LEFT JOIN judged n ON n.club_id = j.club_id AND n.season_end_year = j.season_end_year + 1""",
    "settled": """SELECT club_id, season_end_year, tier, position, n_clubs, CASE WHEN next_tier IS NULL THEN status
        WHEN status IN ('Promoted', 'Play-off Promoted') AND next_tier >= tier THEN 'Stayed' WHEN status = 'Relegated' AND next_tier <= tier THEN 'Stayed'
        WHEN status = 'Stayed' AND next_tier < tier THEN 'Promoted' WHEN status = 'Stayed' AND next_tier > tier THEN 'Relegated' ELSE status END AS status FROM nexts""",
    "fixed": """SELECT c.club_id, c.season_end_year, c.tier, c.position, CASE WHEN c.season_end_year >= 2021 THEN 'In progress' WHEN r.tier IS NULL THEN 'Stayed' WHEN position = 1 THEN 'Champions'
        WHEN position BETWEEN up_lo AND up_hi THEN 'Promoted' WHEN position BETWEEN playoff_lo AND playoff_hi THEN 'Play-off Promoted' WHEN position BETWEEN down_lo AND down_hi THEN 'Relegated'
        ELSE 'Stayed' END AS status
        FROM career c LEFT JOIN rules r ON r.tier = c.tier AND c.season_end_year BETWEEN r.from_year AND r.to_year
        QUALIFY row_number() OVER (PARTITION BY c.club_id, c.season_end_year ORDER BY r.from_year DESC NULLS LAST) = 1""",
    "rollup_": """SELECT club_id, max_by(tier, season_end_year) AS current_tier, min_by(tier, season_end_year) AS first_tier, min(tier) AS highest_tier, max(tier) AS lowest_tier,
        count(DISTINCT CASE WHEN tier = 1 THEN season_end_year END)::BIGINT AS seasons_in_tier1, max(CASE WHEN tier = 1 THEN season_end_year END) AS last_tier1_season,
        min(season_end_year) AS first_season_in_db, max(season_end_year) AS last_season_in_db, count(DISTINCT season_end_year)::BIGINT AS n_seasons,
        count(*) FILTER (WHERE status IN ('Champions', 'Promoted', 'Play-off Promoted') AND tier > 1)::BIGINT AS total_promotions, count(*) FILTER (WHERE status = 'Relegated')::BIGINT AS total_relegations
        FROM settled GROUP BY 1""",
    "rollup": "SELECT *, round_even((total_promotions + total_relegations)::DOUBLE / n_seasons, 2) AS yo_yo_score FROM rollup_",
    "breaks": """SELECT c.club_id, c.season_end_year, l.last, coalesce(c.tier <> l.tier, true) AS broken
        FROM (SELECT club_id, max(season_end_year) AS last, max_by(tier, season_end_year) AS tier, min(season_end_year) AS first FROM career GROUP BY 1) l
        JOIN (SELECT club_id, unnest(range(min(season_end_year), max(season_end_year) + 1)) AS season_end_year FROM career GROUP BY club_id) s USING (club_id)
        LEFT JOIN career c0 ON c0.club_id = s.club_id AND c0.season_end_year = s.season_end_year
        CROSS JOIN LATERAL (SELECT s.club_id AS club_id, s.season_end_year AS season_end_year, c0.tier AS tier) c""",
    "streak": "SELECT club_id, (max(last) - coalesce(max(CASE WHEN broken THEN season_end_year END), min(season_end_year) - 1))::BIGINT AS current_tier_streak FROM breaks GROUP BY 1",
    "filled": """SELECT s.club_id, s.season_end_year, coalesce(c.tier, 6) AS tier FROM (SELECT club_id, unnest(range(min(season_end_year), max(season_end_year) + 1)) AS season_end_year FROM career GROUP BY 1) s
        LEFT JOIN career c USING (club_id, season_end_year)""",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY club_id ORDER BY season_end_year DESC) AS n FROM filled",
    "win": """SELECT club_id, count(*)::BIGINT AS seasons, count(*) FILTER (WHERE tier < 6)::BIGINT AS recorded, quantile_disc(tier, 0.5) AS median, quantile_disc(tier, 0.5) FILTER (WHERE n <= 5) AS recent,
        quantile_disc(tier, 0.5) FILTER (WHERE n BETWEEN 6 AND 15) AS prior, count(*) FILTER (WHERE n BETWEEN 6 AND 15) AS n_prior, bool_or(tier = 6 AND season_end_year < 2006) AS early_gap,
        count(*) FILTER (WHERE tier = 1)::BIGINT AS n1, count(*) FILTER (WHERE tier = 2)::BIGINT AS n2, count(*) FILTER (WHERE tier = 3)::BIGINT AS n3,
        count(*) FILTER (WHERE tier = 4)::BIGINT AS n4, count(*) FILTER (WHERE tier = 5)::BIGINT AS n5, count(*) FILTER (WHERE tier = 6)::BIGINT AS n6 FROM ranked GROUP BY 1""",
    "buckets": "SELECT club_id, tier, count(*) AS n FROM filled GROUP BY 1, 2",
    "spread": "SELECT club_id, max(tier) - min(tier) + 1 AS spread FROM buckets WHERE n >= 2 GROUP BY 1",
    "lv0": """SELECT w.*, o.n AS own, coalesce(b.n, 0) AS below, coalesce(a.n, 0) AS above, coalesce(s.spread, 1) AS spread FROM win w JOIN buckets o ON o.club_id = w.club_id AND o.tier = w.median
        LEFT JOIN buckets b ON b.club_id = w.club_id AND b.tier = w.median - 1 LEFT JOIN buckets a ON a.club_id = w.club_id AND a.tier = w.median + 1 LEFT JOIN spread s ON s.club_id = w.club_id""",
    "lv1": """SELECT *, seasons >= 8 AND recorded >= 4 AS enough, CASE WHEN greatest(below, above) = 0 THEN NULL WHEN below >= above THEN median - 1 ELSE median + 1 END AS adj FROM lv0""",
    "lv2": """SELECT *, CASE WHEN NOT enough THEN 'insufficient' WHEN own = seasons THEN 'ever-present' WHEN own * 5 < seasons * 3 AND adj IS NOT NULL AND (own + greatest(below, above)) * 4 >= seasons * 3 THEN 'yo-yo'
        WHEN own * 5 >= seasons * 3 THEN 'established' WHEN spread >= 4 THEN 'broad' ELSE 'mixed' END AS kind FROM lv1""",
    "names": f"SELECT * FROM {_values(sorted(RU.TIER_NAMES.items()), 't, tname')}",
    "lv3": f"""SELECT l.*, CASE WHEN kind = 'yo-yo' THEN adj END AS second, CASE WHEN early_gap THEN '{RU.OUTSIDE_VAGUE}' ELSE '{RU.OUTSIDE_NAME}' END AS away FROM lv2 l""",
    "level": """SELECT l.club_id, l.seasons, l.recorded, CASE WHEN enough THEN median END AS natural_tier, CASE WHEN enough THEN second END AS second_tier, kind,
        CASE WHEN kind = 'insufficient' THEN 'Insufficient record' WHEN median = 6 THEN 'Mostly ' || away WHEN kind = 'ever-present' THEN coalesce(a.tname, away) || ' ever-present'
             WHEN kind = 'established' THEN 'Established ' || coalesce(a.tname, away)
             WHEN kind = 'yo-yo' THEN coalesce(b.tname, away) || ' / ' || coalesce(c.tname, away) || ' yo-yo club' WHEN kind = 'broad' THEN coalesce(a.tname, away) || ' club (whole-pyramid range)'
             ELSE coalesce(a.tname, away) || ' club' END AS label,
        CASE WHEN enough THEN round_even(own::DOUBLE / seasons, 3) END AS share, CASE WHEN enough THEN recent END AS recent_tier,
        CASE WHEN enough AND n_prior >= 3 THEN CASE WHEN recent < prior THEN 'rising' WHEN recent > prior THEN 'falling' ELSE 'level' END END AS trend,
        CASE WHEN early_gap THEN 'pre2006-gap' END AS coverage_note, n1, n2, n3, n4, n5, n6
        FROM lv3 l LEFT JOIN names a ON a.t = median LEFT JOIN names b ON b.t = least(median, second) LEFT JOIN names c ON c.t = greatest(median, second)""",
    "traj": """SELECT r.*, current_tier_streak, natural_tier, kind, label, trend, CASE WHEN last_season_in_db = (SELECT max(season_end_year) FROM career) AND natural_tier <> 6 THEN current_tier - natural_tier END AS level_gap
        FROM rollup r JOIN streak USING (club_id) JOIN level USING (club_id)""",
    "ev": """SELECT club_id, season_end_year, tier, CASE WHEN status IN ('Champions', 'Promoted', 'Play-off Promoted') AND tier <> 1 THEN 'promotion' WHEN status = 'Relegated' THEN 'relegation'
        WHEN status = 'Stayed' OR (status = 'Champions' AND tier = 1) THEN 'stay' ELSE 'other' END AS kind FROM settled""",
    "runs": """SELECT club_id, kind || CASE WHEN count(*) = 2 THEN '_back_to_back' ELSE '_three_plus' END AS pattern, min(season_end_year) AS first, max(season_end_year) AS last
        FROM (SELECT *, season_end_year - row_number() OVER (PARTITION BY club_id, kind ORDER BY season_end_year) AS i FROM ev WHERE kind IN ('promotion', 'relegation')) GROUP BY club_id, kind, i HAVING count(*) >= 2""",
    "triples": """SELECT a.club_id, CASE a.kind || '-' || b.kind || '-' || c.kind WHEN 'relegation-stay-relegation' THEN 'relegation_held' WHEN 'relegation-promotion-relegation' THEN 'relegation_sandwich'
        WHEN 'promotion-stay-promotion' THEN 'promotion_paused' END AS pattern, a.season_end_year AS first, c.season_end_year AS last
        FROM ev a JOIN ev b ON b.club_id = a.club_id AND b.season_end_year = a.season_end_year + 1 JOIN ev c ON c.club_id = a.club_id AND c.season_end_year = a.season_end_year + 2""",
    "patterns": "SELECT * FROM runs UNION ALL SELECT * FROM triples WHERE pattern IS NOT NULL",
    "latest": "SELECT max(season_end_year) AS latest FROM career",
    "bounds": """SELECT p.*, (SELECT max(tier) FROM career c WHERE c.club_id = p.club_id AND c.season_end_year BETWEEN p.first AND p.last + 1) AS floor_tier,
        (SELECT min(tier) FROM career c WHERE c.club_id = p.club_id AND c.season_end_year BETWEEN p.first AND p.last + 1) AS peak_tier,
        b.tier AS start_tier, n.tier AS now_tier, latest FROM patterns p CROSS JOIN latest LEFT JOIN career b ON b.club_id = p.club_id AND b.season_end_year = p.first - 1
        LEFT JOIN career n ON n.club_id = p.club_id AND n.season_end_year = latest""",
    "outcomes": """SELECT club_id, pattern, first, last, floor_tier, peak_tier, start_tier, now_tier, CASE WHEN last = latest THEN 'unfolding' WHEN now_tier IS NULL THEN 'outside'
        WHEN pattern LIKE 'relegation%' THEN CASE WHEN now_tier <= start_tier THEN 'recovered' WHEN now_tier < floor_tier THEN 'climbing' WHEN now_tier = floor_tier THEN 'stuck' ELSE 'worse' END
        ELSE CASE WHEN peak_tier IS NULL OR now_tier <= peak_tier THEN 'held' WHEN now_tier = peak_tier + 1 THEN 'slipped' ELSE 'fell_back' END END AS outcome FROM bounds""",
    "floors": """SELECT season_end_year, tier, count(*)::BIGINT AS n_clubs, (sum(count(*)) OVER (PARTITION BY season_end_year ORDER BY tier))::BIGINT AS floor FROM career GROUP BY 1, 2""",
    "overall": "SELECT c.*, (position + floor - f.n_clubs)::BIGINT AS overall_position FROM career c JOIN floors f USING (season_end_year, tier)",
    "matches": """SELECT year(o_orderdate) AS season_end_year, (hn.n_regionkey + 1)::BIGINT AS tier, CAST(o_orderdate AS DATE) AS match_date, c_nationkey::BIGINT AS home_id, s_nationkey::BIGINT AS away_id,
        CAST(l_quantity AS BIGINT) % 5 AS fthg, CAST((l_linenumber + l_partkey) % 4 AS BIGINT) AS ftag, l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS shipped
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation hn ON hn.n_nationkey = c_nationkey JOIN nation an ON an.n_nationkey = s_nationkey WHERE c_nationkey <> s_nationkey AND hn.n_regionkey = an.n_regionkey""",
    "m": "SELECT *, CASE WHEN fthg > ftag THEN 'H' WHEN fthg < ftag THEN 'A' ELSE 'D' END AS ftr FROM matches",
    "sides": """SELECT season_end_year, tier, match_date, home_id AS club_id, fthg AS gf, ftag AS ga, CASE ftr WHEN 'D' THEN 'D' WHEN 'H' THEN 'W' ELSE 'L' END AS result, l_orderkey, l_linenumber, l_partkey, l_suppkey, shipped FROM m
        UNION ALL SELECT season_end_year, tier, match_date, away_id, ftag, fthg, CASE ftr WHEN 'D' THEN 'D' WHEN 'A' THEN 'W' ELSE 'L' END, l_orderkey, l_linenumber, l_partkey, l_suppkey, shipped FROM m""",
    "sums": """SELECT season_end_year, tier, club_id, count(*) FILTER (WHERE result = 'W')::BIGINT AS won, count(*) FILTER (WHERE result = 'D')::BIGINT AS drawn, count(*) FILTER (WHERE result = 'L')::BIGINT AS lost,
        sum(gf)::BIGINT AS gf, sum(ga)::BIGINT AS ga FROM sides GROUP BY 1, 2, 3""",
    "full_": "SELECT *, won + drawn + lost AS played, gf - ga AS gd, 3 * won + drawn AS points FROM sums",
    "league": "SELECT *, row_number() OVER (PARTITION BY season_end_year, tier ORDER BY points DESC, gd DESC, gf DESC, club_id)::BIGINT AS position FROM full_",
    "counted": """SELECT season_end_year, tier, n_clubs, n_matches, n_clubs * (n_clubs - 1) * 30 AS n_expected, CASE WHEN n_matches IS NULL THEN NULL WHEN n_matches >= n_clubs * (n_clubs - 1) * 30 THEN 1 ELSE 0 END::BIGINT AS data_complete
        FROM (SELECT season_end_year, tier, count(DISTINCT club_id)::BIGINT AS n_clubs FROM league GROUP BY 1, 2) LEFT JOIN (SELECT season_end_year, tier, count(*)::BIGINT AS n_matches FROM m GROUP BY 1, 2) USING (season_end_year, tier)""",
    "sanctions": """SELECT n_nationkey::BIGINT AS club_id, y::BIGINT AS season_end_year, p AS points, CASE WHEN p = 6 AND n_nationkey % 3 = 0 THEN 0 ELSE 1 END AS applied
        FROM nation, (VALUES (1996), (1998), (2000)) a(y), (VALUES (4), (6)) b(p) WHERE n_nationkey % 4 = 1""",
    "docked": "SELECT club_id, season_end_year, sum(points)::BIGINT AS points_deducted FROM sanctions WHERE applied = 1 GROUP BY 1, 2",
    "jl": """SELECT *, CASE WHEN position = 1 THEN 'Champions' WHEN position = 2 THEN 'Promoted' WHEN position = n THEN 'Relegated' ELSE 'Stayed' END AS status
        FROM (SELECT *, count(*) OVER (PARTITION BY season_end_year, tier) AS n FROM league)""",
    "top_supp": "SELECT max(s_suppkey) AS top FROM supplier",
    "fix": """SELECT o_orderkey AS seq, CAST(o_orderdate AS DATE) AS match_date, o_custkey % 5 + 1 AS tier, o_custkey % (top + 1) AS home_id, (o_orderkey * 7 + 1) % (top + 1) AS away_id FROM orders, top_supp
        WHERE o_custkey % (top + 1) <> (o_orderkey * 7 + 1) % (top + 1) AND CAST(o_orderdate AS DATE) >= DATE '1998-03-02' AND CAST(o_orderdate AS DATE) < DATE '1998-03-10'""",
    "lastrow": "SELECT club_id, max_by(status, season_end_year) AS last_status, max_by(position, season_end_year) AS last_position FROM settled GROUP BY 1",
    "ctx": """SELECT club_id, yo_yo_score, level_gap, kind, highest_tier, last_status, last_position,
        yo_yo_score + CASE WHEN level_gap IS NOT NULL THEN least(abs(level_gap), 3) * 2 + CASE WHEN level_gap < 0 THEN 1 ELSE 0 END + CASE WHEN kind = 'yo-yo' THEN 1 ELSE 0 END ELSE 0 END
        + CASE WHEN last_status <> 'Stayed' THEN 1 ELSE 0 END AS own FROM traj JOIN lastrow USING (club_id)""",
    "scored": """SELECT f.*, round_even((CASE f.tier WHEN 1 THEN 5 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 2 WHEN 5 THEN 2 ELSE 1 END
        + coalesce(h.own + CASE WHEN h.level_gap IS NULL AND h.highest_tier = 1 AND f.tier >= 3 THEN 4 ELSE 0 END, 0) + coalesce(a.own + CASE WHEN a.level_gap IS NULL AND a.highest_tier = 1 AND f.tier >= 3 THEN 4 ELSE 0 END, 0)
        + CASE WHEN h.club_id IS NOT NULL AND a.club_id IS NOT NULL THEN CASE WHEN abs(h.last_position - a.last_position) <= 3 THEN 3 ELSE 0 END + CASE WHEN h.last_position <= 3 AND a.last_position <= 3 THEN 3 ELSE 0 END
        + CASE WHEN home_id = 3 OR away_id = 3 THEN 100 ELSE 0 END ELSE 0 END)::DOUBLE, 4) AS score
        FROM fix f LEFT JOIN ctx h ON h.club_id = home_id LEFT JOIN ctx a ON a.club_id = away_id""",
    "fin0": """SELECT l_suppkey AS club_id, (year(l_shipdate) - 1995) * 4 + quarter(l_shipdate) + 1993 AS season_end_year, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS turnover,
        sum(CAST(round(l_extendedprice * 100 * (1 - l_discount) * (0.4::DOUBLE + (l_suppkey % 7) * 0.125::DOUBLE)) AS BIGINT))::BIGINT AS staff_costs FROM lineitem GROUP BY 1, 2""",
    "fin1": "SELECT f.*, (club_id * 5 + season_end_year * 3) % 7 AS k, CAST(round(s_acctbal * 100) AS BIGINT) AS balance FROM fin0 f JOIN supplier ON s_suppkey = club_id",
    "fin": """SELECT club_id, season_end_year, CASE WHEN k < 5 THEN 'full' WHEN k = 5 THEN 'small_company' ELSE 'not_filed' END AS disclosure, CASE WHEN k < 5 THEN turnover END AS turnover,
        CASE WHEN k < 4 THEN staff_costs END AS staff_costs, CASE WHEN k < 5 THEN balance * (season_end_year % 5 - 2) END AS profit_before_tax FROM fin1""",
    "placed": "SELECT f.*, tier, position FROM fin f JOIN career USING (club_id, season_end_year)",
    "franks": """SELECT club_id, season_end_year, tier, turnover AS value, rank() OVER (PARTITION BY season_end_year, tier ORDER BY turnover DESC)::BIGINT AS rank, count(*) OVER (PARTITION BY season_end_year, tier)::BIGINT AS published
        FROM placed WHERE turnover IS NOT NULL""",
    "pp": "SELECT club_id, season_end_year, tier, overall_position, profit_before_tax AS value FROM fin JOIN overall USING (club_id, season_end_year) WHERE profit_before_tax IS NOT NULL",
    "beaten": """SELECT a.club_id, a.season_end_year, a.tier, a.staff_costs, count(b.club_id)::BIGINT AS beaten FROM placed a LEFT JOIN placed b ON b.season_end_year = a.season_end_year AND b.tier = a.tier - 1
        AND b.staff_costs < a.staff_costs WHERE a.staff_costs IS NOT NULL AND a.tier > 1 GROUP BY 1, 2, 3, 4""",
    "loss": "SELECT club_id, season_end_year, profit_before_tax FROM fin WHERE profit_before_tax < 0 ORDER BY profit_before_tax, club_id, season_end_year LIMIT 1",
    "stay": "SELECT club_id, current_tier_streak FROM traj WHERE current_tier = 1 AND current_tier_streak >= 5 ORDER BY current_tier_streak DESC, club_id LIMIT 1",
    "raw": "SELECT DISTINCT doc_id % 30 + 1994 AS season_end_year, upper(source) || ' F.C.' AS name FROM documents",
    "variants": """SELECT regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key, min(club_id) AS club_id FROM (SELECT 'club-' || i AS club_id, unnest(['Src' || i || ' FC', 'SRC-' || i || ' f.c', 'src' || (i % 7) || 'fc']) AS name
        FROM range(15) t(i)) GROUP BY 1""",
    "resolved": """SELECT season_end_year, name, CASE WHEN regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') = 'src3fc' AND season_end_year = 2000 THEN 'club-other' ELSE club_id END AS club_id
        FROM raw LEFT JOIN variants ON key = regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')""",
    "fc": "SELECT c_custkey AS c, (1990 + c_custkey % 30) AS y FROM customer",
    "tev": """SELECT c AS club_id, 'administration' AS theme, y + 1 AS season_end_year, 'Administration' AS label, 'Entered administration in ' || y || CASE WHEN c % 4 = 1 AND c % 3 <> 0 THEN ', and was docked ' || c % 3 || ' point' || CASE WHEN c % 3 = 1 THEN '' ELSE 's' END ELSE '' END
            || '.' || CASE WHEN c % 8 = 3 THEN ' Debts.' ELSE '' END AS text FROM fc WHERE c % 6 = 1
        UNION ALL SELECT c, 'points-deductions', y, 'Points deduction', 'Docked ' || c % 13 || ' point' || CASE WHEN c % 13 = 1 THEN '' ELSE 's' END || ' in ' || (y - 1) || '/' || lpad((y % 100)::VARCHAR, 2, '0') || '.' FROM fc WHERE c % 9 = 4 AND c % 13 <> 0
        UNION ALL SELECT c, 'exiled', y + 1, 'Exile begins', 'Played home games at Away Park, ' || y || '–99' || CASE WHEN c % 2 = 1 THEN ' — about 12 miles from home' ELSE '' END || '.' FROM fc WHERE c % 11 = 3
        UNION ALL SELECT c, 'ground-grading', y, 'Ground grading', 'Promotion denied on ground grading.' FROM fc WHERE c % 13 = 5
        UNION ALL SELECT c, 'phoenix', y + 1, 'Predecessor folded', 'Old Club ceased to exist in ' || y || '.' FROM fc WHERE c % 10 = 0
        UNION ALL SELECT c, 'phoenix', 1880 + c % 120 + 1, 'Club founded', 'Founded in ' || (1880 + c % 120) || ', succeeding Old Club.' FROM fc WHERE c % 5 = 0
        UNION ALL SELECT c, 'fan-owned', y + 1, 'Fans take control', CASE WHEN c % 14 = 2 THEN 'Trust' ELSE 'The supporters'' trust' END || ' took control in ' || y || '.' FROM fc WHERE c % 7 = 2""",
    "member": """SELECT c AS club_id, unnest(list_distinct(list_filter([CASE WHEN c % 5 = 0 THEN 'phoenix' END, CASE WHEN c % 7 = 2 THEN 'fan-owned' END, CASE WHEN c % 6 = 1 THEN 'administration' END,
        CASE WHEN c % 9 = 4 THEN 'points-deductions' END, CASE WHEN c % 11 = 3 OR c % 17 = 1 THEN 'exiled' END, CASE WHEN c % 13 = 5 THEN 'ground-grading' END, CASE WHEN c % 17 = 1 THEN 'special' END], lambda x: x IS NOT NULL))) AS theme FROM fc""",
    "panel": """SELECT c AS club_id, 1 AS p, 'Nickname' AS label, 'The Blues' AS value FROM fc WHERE c % 8 = 1
        UNION ALL SELECT c, 2, 'Founded', (1880 + c % 120) || CASE WHEN c % 3 = 1 THEN ' · Works team' ELSE '' END FROM fc WHERE c % 5 = 0 UNION ALL SELECT c, 2, 'Origin', 'Works team' FROM fc WHERE c % 5 <> 0 AND c % 3 = 1
        UNION ALL SELECT c, 3, 'Owner', 'Trust (since ' || y || ')' FROM fc WHERE c % 14 = 2 UNION ALL SELECT c, 4, 'Ownership model', 'Fan / supporters'' trust' FROM fc WHERE c % 7 = 2
        UNION ALL SELECT c, 5, 'Stadium', 'Main Road' || CASE WHEN c % 8 = 1 THEN ' (opened ' || (1900 + c % 100) || ')' ELSE '' END FROM fc WHERE c % 4 = 1
        UNION ALL SELECT c, 6, 'Ground ownership', 'Council-owned' FROM fc WHERE c % 5 = 1 UNION ALL SELECT c, 7, 'Capacity', format('{:,}', 10000 + c % 50000) FROM fc WHERE c % 4 = 2
        UNION ALL SELECT c, 8, 'Pitch', 'Artificial 3G' FROM fc WHERE c % 16 = 3
        UNION ALL SELECT c, 9, 'Played home games at', 'Away Park · ' || y || '–99' || CASE WHEN c % 2 = 1 THEN ' · ~12 miles away' ELSE '' END FROM fc WHERE c % 11 = 3
        UNION ALL SELECT c, 10, 'Administration', y || CASE WHEN c % 4 = 1 AND c % 3 <> 0 THEN ' · −' || c % 3 || ' points' ELSE '' END FROM fc WHERE c % 6 = 1
        UNION ALL SELECT c, 11, 'Points deduction', '−' || c % 13 || ' points in ' || (y - 1) || '/' || lpad((y % 100)::VARCHAR, 2, '0') FROM fc WHERE c % 9 = 4 AND c % 13 <> 0
        UNION ALL SELECT c, 12, 'Ground grading', (y - 1) || '/' || lpad((y % 100)::VARCHAR, 2, '0') || ' · Promotion denied on ground grading' FROM fc WHERE c % 13 = 5
        UNION ALL SELECT c, 13, 'Successor to', 'Old Club' || CASE WHEN c % 10 = 0 THEN ' (folded ' || y || ')' ELSE '' END FROM fc WHERE c % 5 = 0
        UNION ALL SELECT c, 14, 'Featured on The rise', (y - 1) || '/' || lpad((y % 100)::VARCHAR, 2, '0') || ' · Climbed' FROM fc WHERE c % 21 = 6
        UNION ALL SELECT c, 15, 'Rivalry', 'vs ' || coalesce(n_name, (c % 5)::VARCHAR) || CASE WHEN c % 24 = 7 THEN ' (Derby)' ELSE '' END || ' · Old grudge' FROM fc LEFT JOIN nation ON n_nationkey = c % 5 WHERE c % 12 = 7""",
    "notes": "SELECT club_id, season_end_year AS last, CASE position WHEN 1 THEN 'Finished 1st' ELSE 'Finished 2nd' END AS note FROM settled WHERE position <= 2",
    "riv": """SELECT club_a, club_b, seq, note FROM (SELECT least(a, b) AS club_a, greatest(a, b) AS club_b, seq, note FROM (SELECT o_orderkey AS seq, o_custkey % 25 AS a, o_orderkey % 27 AS b, o_orderpriority AS note FROM orders) WHERE a <> b AND b IN (SELECT n_nationkey FROM nation))
        QUALIFY row_number() OVER (PARTITION BY club_a, club_b ORDER BY length(coalesce(note, '')) DESC, seq) = 1""",
    "grounds": "SELECT n_nationkey::BIGINT AS id, 50 + (n_nationkey * 37 % 80) / 10.0::DOUBLE AS lat, -5 + (n_nationkey * 53 % 70) / 10.0::DOUBLE AS lon FROM nation",
    "miles": """SELECT a.id, b.id AS other, 3958.8 * 2 * atan2(sqrt(h), sqrt(1 - h)) AS miles FROM grounds a JOIN grounds b ON a.id <> b.id
        CROSS JOIN LATERAL (SELECT pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h)""",
    "days": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders",
    "dayseason": "SELECT day, year(day) + CASE WHEN month(day) >= 7 THEN 1 ELSE 0 END AS y FROM days",
    "grid": "SELECT (year(o_orderdate) - 3 + o_custkey % 40)::BIGINT AS season_end_year, (o_orderkey % 6 + 1)::BIGINT AS tier, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2",
    "divisions": f"SELECT * FROM {_values(RU.DIVISIONS, 'tier, from_year, until_year, division_name')}",
    "filed": """SELECT lpad(((season_end_year - 1) % 100)::VARCHAR, 2, '0') || lpad((season_end_year % 100)::VARCHAR, 2, '0') || '_E' || (tier - 1) || '.csv' AS file, (season_end_year + tier) % 4 = 0 AND l_orderkey % 5 = 0 AS odd FROM m""",
    "clubs": """SELECT s_suppkey AS club_id, s_name AS canonical_name, CASE WHEN s_suppkey % 5 <> 0 THEN 50 + (s_suppkey * 37 % 80) / 10.0::DOUBLE END AS latitude,
        CASE WHEN s_suppkey % 5 <> 0 THEN -5 + (s_suppkey * 53 % 70) / 10.0::DOUBLE END AS longitude FROM supplier WHERE s_suppkey % 9 <> 0""",
    "labelled": f"SELECT * FROM {_values(sorted(RU.PATTERN_LABELS.items()), 'pattern, pattern_label')}",
    "groups": f"SELECT * FROM {_values([(page, i, *g) for page, gs in (('the-drop', RU.FALL_GROUPS), ('the-rise', RU.RISE_GROUPS)) for i, g in enumerate(gs)], 'page, place, outcome, heading, about')}",
    "sections": """SELECT CASE WHEN o.pattern LIKE 'relegation%' THEN 'the-drop' ELSE 'the-rise' END AS page, o.club_id, o.pattern, pattern_label, o.first, o.last, o.outcome,
        (SELECT string_agg((y - 1) || '/' || lpad((y % 100)::VARCHAR, 2, '0'), ' → ' ORDER BY y) FROM (SELECT unnest(range(o.first, o.last + 1)) AS y)) || ' — ' || coalesce(a.tname, '?') || ' to ' || coalesce(b.tname, '?') AS path
        FROM outcomes o JOIN labelled l ON l.pattern = o.pattern LEFT JOIN career c ON c.club_id = o.club_id AND c.season_end_year = o.first LEFT JOIN names a ON a.t = c.tier
        LEFT JOIN names b ON b.t = CASE WHEN o.pattern LIKE 'relegation%' THEN o.floor_tier ELSE o.peak_tier END""",
    "placings": "SELECT s.*, place, heading, about FROM sections s JOIN groups g ON g.page = s.page AND g.outcome = s.outcome",
    "full_traj": """SELECT t.*, recorded, seasons, share, recent_tier, second_tier, coverage_note FROM traj t JOIN (SELECT club_id, recorded, seasons, share, recent_tier, second_tier, coverage_note FROM level) USING (club_id)""",
    "bucket": f"SELECT t.club_id, CASE WHEN natural_tier = 6 THEN CASE WHEN coverage_note IS NOT NULL THEN '{RU.OUTSIDE_VAGUE}' ELSE '{RU.OUTSIDE_NAME}' END ELSE tname END AS natural_name FROM full_traj t LEFT JOIN names ON names.t = natural_tier",
    "recent_bucket": f"SELECT t.club_id, CASE WHEN recent_tier = 6 THEN CASE WHEN coverage_note IS NOT NULL THEN '{RU.OUTSIDE_VAGUE}' ELSE '{RU.OUTSIDE_NAME}' END ELSE tname END AS recent_name FROM full_traj t LEFT JOIN names ON names.t = recent_tier",
    "cards": """SELECT club_id, 1 AS p, 'Natural level' AS label, natural_name AS value FROM full_traj JOIN bucket USING (club_id) WHERE natural_tier IS NOT NULL UNION ALL SELECT club_id, 2, 'Current level', 'Tier ' || current_tier FROM full_traj
        UNION ALL SELECT club_id, 3, 'Seasons at this level', current_tier_streak::VARCHAR FROM full_traj UNION ALL SELECT club_id, 4, 'Top-flight seasons (last ' || last_tier1_season || ')', seasons_in_tier1::VARCHAR FROM full_traj WHERE seasons_in_tier1 > 0
        UNION ALL SELECT club_id, 5, 'Tier range', highest_tier || '–' || lowest_tier FROM full_traj UNION ALL SELECT club_id, 6, 'Promotions', total_promotions::VARCHAR FROM full_traj UNION ALL SELECT club_id, 7, 'Relegations', total_relegations::VARCHAR FROM full_traj
        UNION ALL SELECT club_id, 8, 'Yo-yo score', yo_yo_score::VARCHAR FROM full_traj""",
    "named_divisions": """SELECT c.*, coalesce(division_name, 'Tier ' || c.tier) AS division_name FROM settled c LEFT JOIN divisions d ON d.tier = c.tier AND season_end_year >= from_year AND season_end_year < until_year""",
    "sranks": """SELECT club_id, season_end_year, tier, rank() OVER (PARTITION BY season_end_year, tier ORDER BY staff_costs DESC)::BIGINT AS rank, count(*) OVER (PARTITION BY season_end_year, tier)::BIGINT AS published
        FROM placed WHERE staff_costs IS NOT NULL""",
    "club_seed": "SELECT c_nationkey::BIGINT AS club_id, max_by(c_name, c_custkey) AS canonical_name, max_by(c_custkey % 6, c_custkey) AS current_tier FROM customer WHERE c_nationkey % 6 <> 0 GROUP BY 1",
    "form": """SELECT club_id, string_agg(result, '' ORDER BY n) AS form FROM (SELECT *, row_number() OVER (PARTITION BY club_id ORDER BY season_end_year DESC, match_date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, shipped DESC) AS n,
        max(season_end_year) OVER (PARTITION BY club_id) AS latest FROM sides) WHERE n <= 5 AND season_end_year = latest GROUP BY 1""",
    "last5": """SELECT club_id, string_agg(season_end_year || '/' || tier || '/' || position, ' ' ORDER BY season_end_year DESC) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY club_id ORDER BY season_end_year DESC) AS n FROM settled) WHERE n <= 5 GROUP BY 1""",
    "last1": "SELECT club_id, max_by(status, season_end_year) AS last_status, max_by(position, season_end_year) AS last_position, max_by((n_clubs - position) * 3, season_end_year) AS last_points, max_by((n_clubs - 1) * 2, season_end_year) AS last_played FROM settled GROUP BY 1",
    "since": "SELECT club_id, max(CASE WHEN season_end_year < last AND tier <= now THEN season_end_year END) AS highest_since FROM (SELECT *, max(season_end_year) OVER (PARTITION BY club_id) AS last, first_value(tier) OVER (PARTITION BY club_id ORDER BY season_end_year DESC) AS now FROM career) GROUP BY 1",
    "pctx": """SELECT t.*, canonical_name AS name, last_status, last_position, last_points, last_played, highest_since, form, recent FROM full_traj t JOIN clubs USING (club_id) JOIN last1 USING (club_id) JOIN since USING (club_id) JOIN last5 USING (club_id)
        LEFT JOIN form ON form.club_id = t.club_id""",
    "said": """SELECT p.*, CASE WHEN a.tname LIKE 'League%' THEN a.tname ELSE 'the ' || a.tname END AS here, a.tname AS bare, CASE WHEN lo.tname LIKE 'League%' THEN lo.tname ELSE 'the ' || lo.tname END AS lower_,
        CASE WHEN hi.tname LIKE 'League%' THEN hi.tname ELSE 'the ' || hi.tname END AS upper_, abs(level_gap) || ' division' || CASE WHEN abs(level_gap) = 1 THEN '' ELSE 's' END AS apart
        FROM pctx p LEFT JOIN names a ON a.t = natural_tier LEFT JOIN names lo ON lo.t = least(natural_tier, second_tier) LEFT JOIN names hi ON hi.t = greatest(natural_tier, second_tier)""",
    "leveled": """SELECT *, CASE WHEN natural_tier IS NOT NULL AND kind <> 'insufficient' AND natural_tier <> 6 THEN CASE WHEN kind = 'ever-present' THEN name || ' have never played outside ' || here
        WHEN kind = 'established' THEN name || ' belong in ' || here || ' — ' || CAST(round_even(share * 100, 0) AS BIGINT) || '% of their ' || seasons || ' recorded seasons'
        WHEN kind = 'yo-yo' AND second_tier IS NOT NULL THEN name || ' live between ' || coalesce(lower_, 'the Tier ' || least(natural_tier, second_tier)) || ' and ' || coalesce(upper_, 'the Tier ' || greatest(natural_tier, second_tier))
        WHEN kind = 'broad' THEN name || chr(39) || 's record runs the length of the pyramid, but its centre of gravity is ' || here ELSE name || ' are, on the balance of their record, a ' || bare || ' club' END
        || CASE WHEN level_gap > 0 THEN '; they are ' || apart || ' below that now' WHEN level_gap < 0 AND current_tier_streak >= 3 THEN '; they are ' || current_tier_streak || ' seasons into a spell ' || apart || ' above that'
        WHEN level_gap < 0 AND last_season_in_db - highest_since >= 2 THEN '; this season is their highest since ' || highest_since WHEN level_gap < 0 AND highest_since IS NOT NULL THEN '; they are ' || apart || ' above that this season'
        WHEN level_gap < 0 THEN '; this season is the highest in their record' ELSE '' END END AS level_says FROM said""",
    "hist": f"""SELECT club_id, name, coalesce(level_says, CASE WHEN highest_tier = 1 AND current_tier >= 3 THEN name || ' are a fallen giant — ' || seasons_in_tier1 || ' top-flight season' || CASE WHEN seasons_in_tier1 = 1 THEN '' ELSE 's' END || ', the last in ' || last_tier1_season || ', now '
        || (current_tier - 1) || ' divisions below' WHEN yo_yo_score >= 0.25 THEN name || ' are a classic yo-yo club — ' || total_promotions || ' promotion' || CASE WHEN total_promotions = 1 THEN '' ELSE 's' END || ' and ' || total_relegations || ' relegation'
        || CASE WHEN total_relegations = 1 THEN '' ELSE 's' END || ' since ' || first_season_in_db WHEN current_tier_streak >= 10 THEN name || ' are furniture at this level — ' || current_tier_streak || ' consecutive seasons and counting'
        ELSE name || ' have spent their ' || (last_season_in_db - first_season_in_db + 1) || ' recorded seasons ' || CASE WHEN highest_tier <> lowest_tier THEN 'between tiers ' || highest_tier || ' and ' || lowest_tier ELSE 'entirely at tier ' || highest_tier END END)
        || '; they sit ' || {_ORDINAL.format("last_position")} || ' with ' || last_points || ' points from ' || last_played || ' games' || CASE WHEN form IS NULL THEN '' ELSE ', form ' || form END || '.' AS history FROM leveled""",
    "h2h": """SELECT least(home_id, away_id) AS club_a, greatest(home_id, away_id) AS club_b, count(*)::BIGINT AS total, count(*) FILTER (WHERE (ftr = 'H') = (home_id < away_id) AND ftr <> 'D')::BIGINT AS wins_a,
        count(*) FILTER (WHERE (ftr = 'H') = (home_id > away_id) AND ftr <> 'D')::BIGINT AS wins_b, count(*) FILTER (WHERE ftr = 'D')::BIGINT AS draws FROM m GROUP BY 1, 2""",
    "fixnames": """SELECT f.*, coalesce(hc.canonical_name, home_id::VARCHAR) AS hname, coalesce(ac.canonical_name, away_id::VARCHAR) AS aname, hh.history AS hhist, ah.history AS ahist,
        CASE WHEN month(match_date) >= 7 THEN year(match_date) + 1 ELSE year(match_date) END AS y FROM fix f LEFT JOIN clubs hc ON hc.club_id = home_id LEFT JOIN clubs ac ON ac.club_id = away_id LEFT JOIN hist hh ON hh.club_id = home_id LEFT JOIN hist ah ON ah.club_id = away_id""",
    "segs": """SELECT club_id, segment, any_value(tier) AS tier, min(season_end_year) AS "start", max(season_end_year) AS "end", max(bridge) AS bridged_from, count(*)::BIGINT AS n_points
        FROM (SELECT *, sum(new) OVER (PARTITION BY club_id ORDER BY season_end_year)::BIGINT AS segment FROM (SELECT club_id, season_end_year, tier, CASE WHEN lag(season_end_year) OVER w = season_end_year - 1 AND lag(tier) OVER w = tier THEN 0 ELSE 1 END AS new,
        CASE WHEN lag(season_end_year) OVER w = season_end_year - 1 AND lag(tier) OVER w <> tier THEN lag(season_end_year) OVER w END AS bridge FROM career WINDOW w AS (PARTITION BY club_id ORDER BY season_end_year))) GROUP BY 1, 2""",
    "spots": "SELECT c_custkey AS id, 50 + (c_custkey - c_custkey % 4) * 7919 % 99991 / 12500.0::DOUBLE AS lat, -5 + (c_custkey - c_custkey % 4) * 104729 % 99989 / 14286.0::DOUBLE AS lon FROM customer WHERE c_custkey % 11 <> 0",
    "namekeys": """SELECT id, trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]', ' ', 'g')) AS key FROM (SELECT 'c' || c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT 'p' || p_partkey, p_name FROM part)""",
    "cmoney": "SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) * 37 AS v FROM customer",
}


def sql(select: str) -> str:
    """The select with just those expressions that it needs."""
    import re

    used: list[str] = []
    names = "|".join(sorted(CTE, key=len, reverse=True))

    def need(text: str) -> None:
        for m in re.findall(rf"\b(?:FROM|JOIN|,)\s+({names})\b", text):
            if m not in used:
                need(CTE[m])
                if m not in used:
                    used.append(m)

    need(select)
    order = [n for n in CTE if n in used]
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + f"\n{select}" if order else select


def _money(v: str) -> str:
    a = f"abs({v})::DOUBLE"
    return f"""CASE WHEN {v} < 0 THEN '−' ELSE '' END || CASE WHEN {a} >= 1000000 THEN '£' || CAST(round_even({a} / 1000000, 1) AS DECIMAL(18, 1)) || 'm'
        WHEN {a} >= 1000 THEN '£' || CAST(round_even({a} / 1000, 0) AS BIGINT) || 'k' ELSE '£' || CAST(round_even({a}, 0) AS BIGINT) END"""


_RECORD = "SELECT season_end_year, tier, club_id, points, gd, played FROM league WHERE played >= 30 ORDER BY {}, season_end_year, tier, club_id LIMIT 10"
_SAFE = "SELECT season_end_year, tier, club_id, points, gd, status FROM jl WHERE status = '{}' AND played {} ORDER BY {}, season_end_year, tier, club_id LIMIT 10"
_AXIS = """SELECT '{0}' AS scale, round_even({1}, 3) AS lo, round_even({2}, 3) AS hi FROM (SELECT *, hi - lo AS span FROM (SELECT {3} AS lo, {4} AS hi FROM (SELECT {5} AS v FROM pp)))"""

SELECTS = {
    "league_table": "SELECT season_end_year, tier, club_id, position, played, won, drawn, lost, gf, ga, gd, points FROM league",
    "match_dedup_valid": """SELECT season_end_year, tier, match_date, home_id, away_id, fthg, ftag, ftr FROM m QUALIFY row_number() OVER (PARTITION BY home_id, away_id, match_date ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, shipped) = 1""",
    "division_names": "SELECT g.*, coalesce(division_name, 'Tier ' || g.tier) AS division_name FROM grid g LEFT JOIN divisions d ON d.tier = g.tier AND season_end_year >= from_year AND season_end_year < until_year",
    "rules_lookup": f"SELECT g.*, total_clubs, {RANGES} FROM grid g LEFT JOIN rules r ON r.tier = g.tier AND season_end_year BETWEEN from_year AND to_year QUALIFY row_number() OVER (PARTITION BY g.tier, season_end_year ORDER BY from_year DESC NULLS LAST) = 1",
    "data_completeness": "SELECT * FROM counted",
    "coverage_note": "SELECT season_end_year, tier, CASE WHEN data_complete = 0 AND n_matches > 0 AND n_matches < n_expected THEN n_matches || ' of ' || n_expected || ' matches' END AS note FROM counted",
    "plausible_tables": """SELECT season_end_year, tier, n_clubs FROM (SELECT c.*, total_clubs FROM (SELECT season_end_year, tier, count(*)::BIGINT AS n_clubs FROM career GROUP BY 1, 2) c
        LEFT JOIN rules r ON r.tier = c.tier AND season_end_year BETWEEN from_year AND to_year QUALIFY row_number() OVER (PARTITION BY c.tier, season_end_year ORDER BY from_year DESC NULLS LAST) = 1)
        WHERE total_clubs IS NULL OR n_clubs <= total_clubs""",
    "deductions_rerank": """SELECT season_end_year, tier, club_id, row_number() OVER (PARTITION BY season_end_year, tier ORDER BY p DESC, gd DESC, gf DESC, club_id)::BIGINT AS position, p AS points, d AS points_deducted
        FROM (SELECT l.*, points - coalesce(points_deducted, 0) AS p, coalesce(points_deducted, 0) AS d FROM league l LEFT JOIN docked USING (club_id, season_end_year))""",
    "deduction_totals": "SELECT * FROM docked",
    "assign_status": "SELECT * FROM judged",
    "assign_status_fixed_rules": "SELECT * FROM fixed",
    "reconcile_status": "SELECT * FROM settled",
    "playoff_winners": """SELECT club_id, season_end_year, tier, position, n_clubs, CASE WHEN season_end_year = 2021 AND status = 'Play-off Promoted'
        AND club_id <> min(CASE WHEN status = 'Play-off Promoted' THEN club_id END) OVER (PARTITION BY season_end_year, tier) THEN 'Stayed' ELSE status END AS status FROM settled""",
    "seasons_in_progress": "SELECT DISTINCT season_end_year FROM fixed WHERE status = 'In progress'",
    "status_presentation": f"SELECT s.status, count(*)::BIGINT AS n, slug, direction, label FROM settled s JOIN {_values([(s, *v) for s, v in RU.STATUS_SHOWN.items()], 'status, slug, direction, label')} ON v.status = s.status GROUP BY ALL",
    "club_trajectory": "SELECT club_id, current_tier, first_tier, highest_tier, lowest_tier, seasons_in_tier1, last_tier1_season, first_season_in_db, last_season_in_db, n_seasons, total_promotions, total_relegations, current_tier_streak, natural_tier, kind, trend, level_gap FROM traj",
    "current_tier": "SELECT club_id, current_tier, last_season_in_db FROM rollup",
    "tier_streak": "SELECT * FROM streak",
    "yo_yo": "SELECT club_id, yo_yo_score, n_seasons, total_promotions, total_relegations FROM rollup WHERE n_seasons >= 5 ORDER BY yo_yo_score DESC, n_seasons DESC, club_id LIMIT 25",
    "gap_filled_history": "SELECT * FROM filled",
    "tier_distribution": """SELECT club_id, n1, n2, n3, n4, n5, n6, '{"1":' || n1 || ',"2":' || n2 || ',"3":' || n3 || ',"4":' || n4 || ',"5":' || n5 || ',"outside":' || n6 || '}' AS tier_distribution FROM level""",
    "natural_level": "SELECT club_id, seasons, recorded, natural_tier, second_tier, kind, label, share, coverage_note FROM level",
    "level_trend": "SELECT club_id, recent_tier, trend FROM level",
    "level_gap": "SELECT club_id, current_tier, natural_tier, level_gap FROM traj",
    "tagline": "SELECT club_id, CASE WHEN kind <> 'insufficient' THEN label WHEN highest_tier = 1 AND current_tier >= 3 THEN 'Fallen giant' WHEN yo_yo_score >= 0.25 THEN 'Yo-yo club' ELSE 'Tiers ' || highest_tier || '-' || lowest_tier END AS tagline FROM traj",
    "club_flags": """SELECT club_id, now, now = 0 AS defunct, highest_tier = 1 AND coalesce(nullif(now, 0), 9) >= 3 AS fallen, yo_yo_score >= 0.25 AS yoyo, n_seasons = (SELECT count(DISTINCT season_end_year) FROM career) AS everpresent
        FROM (SELECT *, CASE WHEN last_season_in_db = (SELECT max(season_end_year) FROM career) THEN current_tier ELSE 0 END AS now FROM rollup)""",
    "movement_runs": "SELECT * FROM runs",
    "movement_triples": "SELECT * FROM triples WHERE pattern IS NOT NULL",
    "sequence_outcomes": "SELECT * FROM outcomes",
    "movement_stats": "SELECT pattern, outcome, count(*)::BIGINT AS records, count(DISTINCT club_id)::BIGINT AS clubs FROM outcomes GROUP BY 1, 2",
    "overall_position": "SELECT club_id, season_end_year, overall_position FROM overall",
    "tier_floors": "SELECT * FROM floors",
    "floor_lines": "SELECT season_end_year, '[' || coalesce(string_agg(floor, ',' ORDER BY floor) FILTER (WHERE floor < top), '') || ']' AS floors, max(top) AS max_position FROM (SELECT *, max(floor) OVER (PARTITION BY season_end_year) AS top FROM floors) GROUP BY 1",
    "tier_segments": "SELECT * FROM segs",
    "ribbon": """SELECT c.club_id, s.season_end_year, t.tier, CASE WHEN EXISTS (SELECT 1 FROM runs r WHERE r.club_id = c.club_id AND s.season_end_year BETWEEN r.first AND r.last) THEN 1 ELSE 0 END::BIGINT AS in_pattern
        FROM (SELECT DISTINCT club_id FROM runs) c CROSS JOIN (SELECT DISTINCT season_end_year FROM career) s LEFT JOIN career t ON t.club_id = c.club_id AND t.season_end_year = s.season_end_year""",
    "matrix_cells": "SELECT season_end_year, tier, '[' || string_agg(club_id, ',' ORDER BY position) || ']' AS clubs FROM career GROUP BY 1, 2",
    "season_links": "SELECT season_end_year, lag(season_end_year) OVER (ORDER BY season_end_year) AS previous, lead(season_end_year) OVER (ORDER BY season_end_year) AS next FROM (SELECT DISTINCT season_end_year FROM career)",
    "chart_payload": "SELECT club_id, '[' || string_agg('[' || season_end_year || ',' || overall_position || ']', ',' ORDER BY season_end_year) || ']' AS points FROM overall GROUP BY 1",
    "map_payload": """SELECT club_id, '{' || string_agg('"' || season_end_year || '":' || tier, ',' ORDER BY season_end_year) || '}' AS tiers FROM career GROUP BY 1""",
    "single_tier_rank": "SELECT season_end_year, club_id, row_number() OVER (PARTITION BY season_end_year ORDER BY overall_position)::BIGINT AS x FROM overall WHERE tier = 2",
    "head_to_head": """SELECT least(home_id, away_id) AS club_a, greatest(home_id, away_id) AS club_b, count(*)::BIGINT AS total, count(*) FILTER (WHERE (ftr = 'H') = (home_id < away_id) AND ftr <> 'D')::BIGINT AS wins_a,
        count(*) FILTER (WHERE (ftr = 'H') = (home_id > away_id) AND ftr <> 'D')::BIGINT AS wins_b, count(*) FILTER (WHERE ftr = 'D')::BIGINT AS draws FROM m GROUP BY 1, 2""",
    "recent_form": """SELECT club_id, season_end_year, string_agg(result, '' ORDER BY n) AS form FROM (SELECT *, row_number() OVER (PARTITION BY club_id ORDER BY season_end_year DESC, match_date DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, shipped DESC) AS n,
        max(season_end_year) OVER (PARTITION BY club_id) AS latest FROM sides) WHERE n <= 5 AND season_end_year = latest GROUP BY 1, 2""",
    "last_five_seasons": "SELECT club_id, season_end_year, tier, position, status, row_number() OVER (PARTITION BY club_id ORDER BY season_end_year DESC)::BIGINT AS nth FROM settled QUALIFY nth <= 5",
    "highest_since": "SELECT club_id, max(CASE WHEN season_end_year < last AND tier <= now THEN season_end_year END) AS highest_since FROM (SELECT *, max(season_end_year) OVER (PARTITION BY club_id) AS last, first_value(tier) OVER (PARTITION BY club_id ORDER BY season_end_year DESC) AS now FROM career) GROUP BY 1",
    "season_progress": "SELECT season_end_year, count(DISTINCT tier)::BIGINT AS divisions, max(played) AS max_played FROM league GROUP BY 1",
    "fixture_window": "SELECT * FROM fix",
    "storyline_score": "SELECT * FROM scored",
    "featured_fixtures": "SELECT seq, row_number() OVER (ORDER BY score DESC, seq)::BIGINT AS featured, score FROM scored QUALIFY featured <= 6",
    "finance_rank": "SELECT * FROM franks",
    "wage_ratio": "SELECT club_id, season_end_year, round_even(staff_costs * 100.0::DOUBLE / turnover, 3) AS wage_ratio FROM fin WHERE staff_costs IS NOT NULL AND turnover <> 0",
    "disclosure_counts": "SELECT season_end_year, count(*)::BIGINT AS in_season, count(*) FILTER (WHERE disclosure = 'full')::BIGINT AS disclosed, count(*) FILTER (WHERE disclosure IN ('small_company', 'not_filed'))::BIGINT AS withheld FROM career LEFT JOIN fin USING (club_id, season_end_year) GROUP BY 1",
    "metric_points": "SELECT club_id, season_end_year, tier, overall_position, staff_costs AS value FROM fin JOIN overall USING (club_id, season_end_year) WHERE staff_costs IS NOT NULL",
    "metric_landing": "SELECT max(season_end_year) AS season_end_year FROM pp WHERE season_end_year IN (SELECT DISTINCT season_end_year FROM career ORDER BY 1 DESC LIMIT 6)",
    "metric_catalogue": f"SELECT metric, label, source, field, scale, format, CAST(benchmark AS DOUBLE) AS benchmark, coalesce(n, 0)::BIGINT AS n, first, last FROM {_values(RU.METRICS, 'metric, label, source, field, scale, format, benchmark')} LEFT JOIN (SELECT field, count(*) AS n, min(season_end_year) AS first, max(season_end_year) AS last FROM (SELECT season_end_year, unnest(['turnover', 'staff_costs', 'profit_before_tax', 'wage_ratio']) AS field, unnest([turnover IS NOT NULL, staff_costs IS NOT NULL, profit_before_tax IS NOT NULL, staff_costs IS NOT NULL AND turnover <> 0]) AS known FROM fin WHERE disclosure = 'full') WHERE known GROUP BY 1) USING (field)",
    "finance_validation": """SELECT * FROM (SELECT club_id, season_end_year, concat_ws('; ', CASE WHEN k = 1 THEN 'bad disclosure' END, CASE WHEN d <> 'full' AND coalesce(t, staff_costs, profit_before_tax) IS NOT NULL THEN 'money without full disclosure' END,
        CASE WHEN k = 4 AND staff_costs IS NOT NULL THEN 'staff costs without definition' END, CASE WHEN k = 3 THEN 'bad staff costs definition' END, CASE WHEN k = 5 THEN 'bad consolidation level' END, CASE WHEN k = 6 THEN 'flags are no JSON array' END) AS errors
        FROM (SELECT *, (club_id * 3 + season_end_year) % 11 AS k, CASE WHEN (club_id * 3 + season_end_year) % 11 = 1 THEN 'partial' ELSE disclosure END AS d, CASE WHEN (club_id * 3 + season_end_year) % 11 = 2 THEN 5 ELSE turnover END AS t FROM fin)) WHERE errors <> ''""",
    "outspender": "SELECT * FROM beaten WHERE beaten > 0 ORDER BY beaten DESC, staff_costs DESC, club_id, season_end_year LIMIT 10",
    "biggest_loss": "SELECT * FROM loss",
    "y_axis": " UNION ALL ".join(
        (
            _AXIS.format("linear", "greatest(0, lo - greatest(1, round_even(span * 0.08, 0)))", "hi + greatest(1, round_even(span * 0.08, 0))", "min(v)", "max(v)", "value::DOUBLE"),
            _AXIS.format("signed", "lo - greatest(1, span * 0.08)", "hi + greatest(1, span * 0.08)", "least(min(v), 0)", "greatest(max(v), 0)", "value::DOUBLE"),
            _AXIS.format("log", "lo - greatest(0.05, span * 0.08)", "hi + greatest(0.05, span * 0.08)", "min(v)", "max(v)", "CASE WHEN value > 0 THEN log10(value::DOUBLE) END"),
        )
    ),
    "club_finances": f"""SELECT club_id, season_end_year, {_money("(turnover / 100.0::DOUBLE)")} AS turnover, {_money("(profit_before_tax / 100.0::DOUBLE)")} AS profit, {_ORDINAL.format("rank")} || ' of ' || published AS rank,
        CASE disclosure WHEN 'small_company' THEN 'abridged accounts' WHEN 'not_filed' THEN 'exempt from publication' END AS note FROM placed LEFT JOIN franks USING (club_id, season_end_year)""",
    "longest_stay": "SELECT * FROM stay",
    "longest_runs": "SELECT * FROM streak ORDER BY current_tier_streak DESC, club_id LIMIT 10",
    "records_most_points": _RECORD.format("points DESC, gd DESC"),
    "records_fewest_points": _RECORD.format("points, gd"),
    "records_best_difference": _RECORD.format("gd DESC, points DESC"),
    "records_worst_difference": _RECORD.format("gd, points"),
    "safe_thresholds_long_down": _SAFE.format("Relegated", ">= 120", "points DESC, gd"),
    "safe_thresholds_long_stayed": _SAFE.format("Stayed", ">= 120", "points, gd DESC"),
    "safe_thresholds_short_down": _SAFE.format("Relegated", "BETWEEN 30 AND 119", "points DESC, gd"),
    "safe_thresholds_short_stayed": _SAFE.format("Stayed", "BETWEEN 30 AND 119", "points, gd DESC"),
    "points_relegated": "SELECT season_end_year, tier, club_id, points FROM jl WHERE status = 'Relegated' AND played >= 30 AND NOT EXISTS (SELECT 1 FROM docked d WHERE d.club_id = jl.club_id AND d.season_end_year = jl.season_end_year) ORDER BY points DESC, season_end_year, tier, club_id LIMIT 1",
    "fallen_giants": "SELECT club_id, current_tier, last_tier1_season FROM rollup WHERE highest_tier = 1 AND current_tier >= 3",
    "risers": "SELECT club_id, first_tier, current_tier FROM rollup WHERE first_tier >= 4 AND current_tier <= 2",
    "level_above": "SELECT club_id, level_gap, kind FROM traj WHERE level_gap < 0 ORDER BY level_gap, club_id LIMIT 25",
    "level_below": "SELECT club_id, level_gap, kind FROM traj WHERE level_gap > 0 ORDER BY level_gap DESC, club_id LIMIT 25",
    "season_champions": "SELECT season_end_year, club_id FROM career WHERE tier = 1 AND position = 1",
    "front_page_hooks": """SELECT hook, club_id, value, priority FROM (SELECT * FROM (SELECT 'wage ratio' AS hook, club_id, season_end_year::BIGINT AS value, 0::BIGINT AS priority FROM fin WHERE staff_costs * 100.0 / turnover >= 100
        ORDER BY staff_costs * 100.0::DOUBLE / turnover DESC, club_id, season_end_year LIMIT 1) UNION ALL SELECT 'biggest loss', club_id, profit_before_tax, 1 FROM loss
        UNION ALL SELECT * FROM (SELECT 'outspender', club_id, beaten, 2 FROM beaten WHERE beaten > 0 ORDER BY beaten DESC, staff_costs DESC, club_id, season_end_year LIMIT 1)
        UNION ALL SELECT 'longest stay', club_id, current_tier_streak, 3 FROM stay) ORDER BY priority LIMIT 4""",
    "scale_counts": "SELECT * FROM (SELECT 'clubs' AS what, count(DISTINCT club_id)::BIGINT AS n FROM career UNION ALL SELECT 'seasons', count(DISTINCT season_end_year) FROM career UNION ALL SELECT 'accounts', count(*) FROM fin WHERE disclosure = 'full') WHERE n > 0",
    "teams_by_letter": "SELECT upper(n_name[1]) AS letter, count(*)::BIGINT AS n, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1",
    "name_search": "SELECT * FROM (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]', ' ', 'g')) AS key FROM customer) WHERE contains(key, '00001') ORDER BY key, c_custkey LIMIT 8",
    "name_resolution": "SELECT * FROM resolved",
    "unresolved_report": """SELECT name, n AS n_places, array_to_string(p[1:5], ', ') || CASE WHEN n > 5 THEN ' +' || (n - 5) || ' more' ELSE '' END AS places
        FROM (SELECT name, count(DISTINCT season_end_year)::BIGINT AS n, list_sort(list(DISTINCT season_end_year || '/E0')) AS p FROM resolved WHERE club_id IS NULL GROUP BY 1)""",
    "stale_keys": "SELECT DISTINCT c_nationkey::BIGINT AS key FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)",
    "name_keys": "SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '', 'g')) AS key FROM documents",
    "text_first_year": "SELECT doc_id, y AS year, y + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS season_end_year FROM (SELECT doc_id, CAST(nullif(regexp_extract(text, '(1[89]\\d{2}|20\\d{2})', 1), '') AS BIGINT) AS y FROM documents)",
    "season_labels": """SELECT day, y AS season_end_year, lpad(((y - 1) % 100)::VARCHAR, 2, '0') || lpad((y % 100)::VARCHAR, 2, '0') AS code, y AS back, (y - 1) || '/' || lpad((y % 100)::VARCHAR, 2, '0') AS label,
        (y - 1) || '-' || lpad((y % 100)::VARCHAR, 2, '0') AS slug, day >= make_date(y - 1, 8, 1) AS published, 'football-data.co.uk/' || lpad(((y - 1) % 100)::VARCHAR, 2, '0') || lpad((y % 100)::VARCHAR, 2, '0') || '/E1' AS source FROM dayseason""",
    "money_format": f"SELECT c_custkey, {_money('v')} AS money FROM cmoney",
    "ordinals": f"SELECT p_partkey, {_ORDINAL.format('p_partkey')} AS ordinal FROM part",
    "date_parsing": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "tolerant_numbers": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1000 + c_custkey % 1000 WHEN 1 THEN c_custkey END::BIGINT AS n, CASE c_custkey % 4 WHEN 0 THEN '1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') WHEN 1 THEN c_custkey || '.9' WHEN 2 THEN '-' END AS kept FROM customer""",
    "json_arrays": "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE 2 END::BIGINT AS n, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "theme_membership": """SELECT * FROM (SELECT c AS club_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN c % 5 = 0 THEN 'phoenix' END, CASE WHEN c % 7 = 2 THEN 'fan-owned' END, CASE WHEN c % 6 = 1 THEN 'administration' END,
        CASE WHEN c % 9 = 4 THEN 'points-deductions' END, CASE WHEN c % 11 = 3 OR c % 17 = 1 THEN 'exiled' END, CASE WHEN c % 13 = 5 THEN 'ground-grading' END, CASE WHEN c % 17 = 1 THEN 'special' END], lambda x: x IS NOT NULL))), ',') AS themes FROM fc) WHERE themes <> ''""",
    "theme_events": "SELECT club_id, theme, season_end_year, label, text FROM tev",
    "boom_and_bust": "SELECT theme, count(DISTINCT club_id)::BIGINT AS clubs, count(*)::BIGINT AS events, min(season_end_year) AS first, max(season_end_year) AS last FROM tev WHERE theme IN ('administration', 'points-deductions') GROUP BY 1",
    "rivalry_dedup": "SELECT club_a, club_b, seq, note FROM riv",
    "ground_distance": "SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY miles, other)::BIGINT AS nth, round(miles, 6) AS miles FROM miles QUALIFY nth <= 3",
    "club_colour": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN '#1a5c9a' WHEN p_partkey % 4 = 1 THEN '#a00000' WHEN p_partkey % 3 = 0 THEN '#000080' ELSE '#1a5c9a' END AS colour FROM part""",
    "rule_periods": """SELECT tier, from_year, to_year, sum(n)::BIGINT AS n_orders FROM (SELECT y, n, r.tier, from_year, to_year FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) o JOIN rules r ON y BETWEEN from_year AND to_year
        QUALIFY row_number() OVER (PARTITION BY y, r.tier ORDER BY from_year DESC) = 1) GROUP BY 1, 2, 3""",
    "theme_narrative": "SELECT m.club_id, m.theme, coalesce(string_agg(text, ' ' ORDER BY season_end_year, text), '') AS narrative FROM member m LEFT JOIN tev t ON t.club_id = m.club_id AND t.theme = m.theme GROUP BY 1, 2",
    "theme_chart": "SELECT t.club_id, theme, t.season_end_year, label, overall_position, overall_position IS NOT NULL AS on_chart FROM tev t LEFT JOIN overall o ON o.club_id = t.club_id AND o.season_end_year = t.season_end_year",
    "facts_panel": "SELECT club_id, row_number() OVER (PARTITION BY club_id ORDER BY p)::BIGINT - 1 AS n, label, value FROM panel",
    "level_panel": "SELECT * FROM (SELECT club_id, tier::BIGINT AS bucket, count(*)::BIGINT AS n, round_even(count(*) * 100.0::DOUBLE / any_value(seasons), 2) AS percent FROM filled JOIN win USING (club_id) GROUP BY 1, 2)",
    "featured_notes": "SELECT p.club_id, p.last, pattern, first, note FROM patterns p JOIN notes n ON n.club_id = p.club_id AND n.last = p.last",
    "unmatched_notes": "SELECT * FROM notes n WHERE NOT EXISTS (SELECT 1 FROM patterns p WHERE p.club_id = n.club_id AND p.last = n.last)",
    "rivalry_stats": "SELECT club_id, count(*)::BIGINT AS rivals, max(length(note))::BIGINT AS longest_note FROM (SELECT club_a AS club_id, note FROM riv UNION ALL SELECT club_b, note FROM riv) GROUP BY 1",
    "division_list": "SELECT c.*, coalesce(division_name, 'Tier ' || c.tier) AS division_name, (season_end_year - 1) || '/' || lpad((season_end_year % 100)::VARCHAR, 2, '0') AS label FROM (SELECT DISTINCT season_end_year, tier FROM career) c LEFT JOIN divisions d ON d.tier = c.tier AND season_end_year >= from_year AND season_end_year < until_year",
    "club_directory": "SELECT club_id, canonical_name, current_tier, highest_tier FROM rollup JOIN clubs USING (club_id)",
    "display_names": "SELECT seq, home_id AS club_id, coalesce(canonical_name, home_id::VARCHAR) AS name, EXISTS (SELECT 1 FROM career c WHERE c.club_id = home_id) AS linked FROM fix LEFT JOIN clubs ON clubs.club_id = home_id",
    "season_by_season": """SELECT club_id, season_end_year, (season_end_year - 1) || '/' || lpad((season_end_year % 100)::VARCHAR, 2, '0') AS season, (season_end_year - 1) || '-' || lpad((season_end_year % 100)::VARCHAR, 2, '0') AS slug, division_name, position, status,
        row_number() OVER (PARTITION BY club_id ORDER BY season_end_year DESC)::BIGINT AS nth FROM named_divisions""",
    "stat_cards": "SELECT club_id, row_number() OVER (PARTITION BY club_id ORDER BY p)::BIGINT - 1 AS n, label, value FROM cards",
    "level_lines": """SELECT club_id, label, CASE WHEN recorded < seasons THEN seasons || ' seasons, ' || recorded || ' of them inside the top five tiers' ELSE seasons || ' recorded seasons' END AS window_note,
        CASE trend WHEN 'rising' THEN 'Rising — the last five seasons average out at ' || recent_name || '.' WHEN 'falling' THEN 'Falling — the last five seasons average out at ' || recent_name || '.' WHEN 'level' THEN 'Holding steady against the previous decade.' END AS trend_line,
        CASE WHEN level_gap <> 0 THEN 'Currently ' || abs(level_gap) || ' division' || CASE WHEN abs(level_gap) > 1 THEN 's' ELSE '' END || CASE WHEN level_gap > 0 THEN ' below' ELSE ' above' END || ' that level.' END AS gap_line
        FROM full_traj JOIN recent_bucket USING (club_id) WHERE natural_tier IS NOT NULL""",
    "movement_sections": "SELECT page, place::BIGINT AS place, heading, about AS note, club_id, pattern_label, path, last FROM placings",
    "movement_page_stats": """SELECT page, count(*)::BIGINT AS records, count(DISTINCT club_id)::BIGINT AS clubs, count(*) FILTER (WHERE outcome IN ('recovered', 'held'))::BIGINT AS good,
        count(*) FILTER (WHERE outcome IN ('stuck', 'outside', 'slipped', 'fell_back'))::BIGINT AS bad FROM sections GROUP BY 1""",
    "featured_movement": "SELECT page, p.club_id, pattern_label, p.last, n.note, outcome, heading FROM placings p JOIN notes n ON n.club_id = p.club_id AND n.last = p.last",
    "case_study": "SELECT club_id, label AS natural_level_label, yo_yo_score, total_promotions, total_relegations FROM traj WHERE club_id = 7",
    "map_rows": """SELECT r.club_id, canonical_name, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, current_tier, (SELECT '{' || string_agg('"' || season_end_year || '":' || tier, ',' ORDER BY season_end_year) || '}' FROM career c WHERE c.club_id = r.club_id) AS tiers
        FROM rollup r JOIN clubs ON clubs.club_id = r.club_id WHERE latitude IS NOT NULL""",
    "map_filter": "SELECT r.club_id, c.tier FROM rollup r JOIN career c ON c.club_id = r.club_id WHERE yo_yo_score >= 0.25 AND season_end_year = 2010 AND tier IN (2, 3)",
    "teams_by_tier": "SELECT current_tier AS tier, any_value(tname) AS label, count(*)::BIGINT AS n, '[' || string_agg(club_id, ',' ORDER BY club_id) || ']' AS clubs FROM rollup JOIN names ON names.t = current_tier GROUP BY 1",
    "timeline": f"SELECT coalesce(v.year, o.year)::BIGINT AS year, title, text, n, finished FROM {_values(RU.TIMELINE, 'year, title, text')} FULL JOIN (SELECT year(o_orderdate) + o_custkey % 3 AS year, count(*)::BIGINT AS n, count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS finished FROM orders GROUP BY 1) o ON o.year = v.year",
    "top_yo_yo": "SELECT canonical_name, yo_yo_score, total_promotions, total_relegations FROM rollup JOIN clubs USING (club_id) ORDER BY yo_yo_score DESC, club_id LIMIT 10",
    "clubs_unresolved": "SELECT DISTINCT name, season_end_year FROM resolved WHERE club_id IS NULL",
    "club_history": "SELECT season_end_year, tier, division_name, position, status FROM named_divisions WHERE club_id = 3",
    "scatter_payload": "SELECT season_end_year, '[' || string_agg('[' || overall_position || ',' || club_id || ',' || staff_costs || ']', ',' ORDER BY overall_position, club_id) || ']' AS points FROM fin JOIN overall USING (club_id, season_end_year) WHERE staff_costs IS NOT NULL GROUP BY 1",
    "revenue_breakdown": f"""SELECT club_id, season_end_year, CASE WHEN turnover IS NOT NULL THEN concat_ws(' · ', CASE WHEN k <> 0 THEN 'matchday ' || {_money("(turnover // 400)")} END, CASE WHEN k <> 1 THEN 'broadcast ' || {_money("(turnover // 250)")} END,
        CASE WHEN k > 1 THEN 'commercial ' || {_money("(turnover // 1000)")} END) END AS breakdown FROM (SELECT club_id, season_end_year, turnover, (club_id + season_end_year) % 4 AS k FROM fin)""",
    "account_notes": f"""SELECT club_id, season_end_year, note AS disclosure_note, CASE WHEN disclosure = 'full' AND k = 3 THEN '18-month period' END AS period_note,
        CASE k WHEN 0 THEN '{RU.FLAG_LABELS["figure_disputed"].replace("'", "''")} {RU.FLAG_LABELS["profit_figure_omitted"].replace("'", "''")}' WHEN 2 THEN '{RU.FLAG_LABELS["figure_disputed"].replace("'", "''")}' ELSE '' END AS flag_notes
        FROM (SELECT *, (club_id * 2 + season_end_year) % 6 AS k FROM fin) LEFT JOIN {_values([(k, v) for k, v in RU.DISCLOSURES.items() if v], 'd, note')} ON d = disclosure""",
    "rank_titles": f"""SELECT club_id, season_end_year, {_ORDINAL.format("rank")} || ' of ' || published AS short, CASE WHEN rank = 1 THEN 'Highest' ELSE {_ORDINAL.format("rank")} || ' highest' END || ' wage bill of the ' || published || ' clubs with published figures in ' || division_name || ', '
        || (season_end_year - 1) || '/' || lpad((season_end_year % 100)::VARCHAR, 2, '0') AS title FROM sranks JOIN (SELECT club_id, season_end_year, division_name FROM named_divisions) USING (club_id, season_end_year)""",
    "seed_clubs": "SELECT * FROM club_seed",
    "seed_detach": "SELECT season_end_year, CASE WHEN club_id IN (SELECT club_id FROM club_seed) THEN club_id END AS club_id, count(*)::BIGINT AS n FROM league GROUP BY 1, 2",
    "seed_finances": """SELECT season_end_year, CASE WHEN bad THEN 'skipped' ELSE 'kept' END AS what, count(*)::BIGINT AS n FROM (SELECT CASE WHEN k = 1 THEN NULL ELSE season_end_year END AS season_end_year, k <= 1 OR club_id % 9 = 0 AS bad
        FROM (SELECT *, (club_id + season_end_year) % 7 AS k FROM fin)) GROUP BY 1, 2""",
    "seed_deductions": """SELECT seq, club_id, concat_ws('; ', CASE WHEN club_id NOT IN (SELECT n_nationkey FROM nation) THEN 'unknown club' END, CASE k WHEN 1 THEN 'missing season or points' WHEN 2 THEN 'points not positive' WHEN 3 THEN 'applied is no flag' WHEN 4 THEN 'no source' END) AS errors
        FROM (SELECT o_orderkey AS seq, o_custkey % 30 AS club_id, o_orderkey % 8 AS k FROM orders)""",
    "story_facts": """SELECT c AS club_id, CASE WHEN ok AND c % 2 = 0 THEN 1800 + c % 100 END AS founded, CASE WHEN ok AND c % 3 = 0 THEN 2000 + c % 100 END AS owner_since, CASE WHEN ok AND c % 4 = 1 THEN 1900 + c % 100 END AS year,
        concat_ws(',', CASE WHEN ok AND c % 4 = 1 THEN 'administration' END, CASE WHEN ok AND c % 5 = 2 THEN 'exiled' END, CASE WHEN ok AND c % 3 = 0 THEN 'fan-owned' END) AS themes FROM (SELECT c, c % 19 <> 7 AS ok FROM fc)""",
    "boom_and_bust_stats": "SELECT count(DISTINCT club_id)::BIGINT AS clubs, count(*)::BIGINT AS events, (SELECT sum(c % 13)::BIGINT FROM fc WHERE c % 9 = 4) AS points, (min(season_end_year) - 1) || '–' || max(season_end_year) AS span FROM tev WHERE theme IN ('administration', 'points-deductions')",
    "name_key_cases": "SELECT c_custkey, ['Bodø/Glimt', 'Łódź', 'Plzeň', 'Beşiktaş', 'ＡＦＣ Wimbledon', 'King’s Lynn Town', 'Málaga CF', 'Brighton & Hove Albion'][c_custkey % 8 + 1] || ' ' || c_name AS name, ['bodglimt', 'odz', 'plzen', 'besiktas', 'afcwimbledon', 'kingslynntown', 'malagacf', 'brightonhovealbion'][c_custkey % 8 + 1] || regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key FROM customer",
    "followed_clubs": "SELECT club_id, count(*)::BIGINT AS n FROM (SELECT home_id AS club_id FROM fix UNION ALL SELECT away_id FROM fix) WHERE club_id IN (3, 5, 8) GROUP BY 1",
    "club_context": "SELECT club_id, name, last_status, last_position, last_points, last_played, highest_since, form, recent FROM pctx",
    "history_sentences": "SELECT club_id, name, history FROM hist",
    "fixture_narratives": """SELECT seq, hname || ' host ' || aname || ' in ' || CASE WHEN division LIKE 'League%' THEN division ELSE 'the ' || division END || ' on ' || strftime(match_date, '%A %d %B') || '.' || coalesce(' ' || hhist, '') || coalesce(' ' || ahist, '')
        || CASE WHEN total IS NOT NULL AND hhist IS NOT NULL AND ahist IS NOT NULL THEN ' They have met ' || total || ' times in league play since 1993: ' || hname || ' ' || CASE WHEN home_id < away_id THEN wins_a ELSE wins_b END || ' wins, ' || aname || ' '
        || CASE WHEN home_id < away_id THEN wins_b ELSE wins_a END || ', ' || draws || ' drawn.' ELSE '' END AS narrative
        FROM (SELECT f.*, coalesce(division_name, 'Tier ' || f.tier) AS division FROM fixnames f LEFT JOIN divisions d ON d.tier = f.tier AND y >= from_year AND y < until_year) f LEFT JOIN h2h ON club_a = least(home_id, away_id) AND club_b = greatest(home_id, away_id)""",
    "division_guard": "SELECT file, count(*)::BIGINT AS n FROM filed GROUP BY 1 HAVING NOT bool_or(odd)",
    "foreign_codes": "SELECT file, CASE WHEN bool_or(odd) THEN 'SP1' ELSE '' END AS foreign FROM filed GROUP BY 1",
    "complete_seasons": "SELECT season_end_year, tier, season_end_year < 2000 OR n_matches >= n_expected * 0.95 AS complete FROM counted",
    "replaced_seasons": "SELECT season_end_year, tier, club_id, points - CASE WHEN season_end_year = 1998 THEN 1 ELSE 0 END AS points, CASE WHEN season_end_year = 1998 THEN 'again' END AS source FROM league",
    "story_sections": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'Began.' END AS origins, CASE WHEN c_custkey % 7 = 0 THEN 'Owned.' END AS ownership, (CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END)::BIGINT AS n,
        'Intro.' || CASE WHEN c_custkey % 3 = 0 THEN chr(10) || chr(10) || '## Odd' || chr(10) || chr(10) || 'More.' ELSE '' END AS extra FROM customer""",
    "published_seasons": "SELECT season_end_year, tier, club_id, points - CASE WHEN season_end_year = 1998 THEN 1 ELSE 0 END AS points, CASE WHEN season_end_year = 1998 THEN 'again' END AS source FROM league",
    "seed_changes": """SELECT 'clubs' AS "table", CASE c_custkey % 10 WHEN 1 THEN 'inserted' WHEN 2 THEN 'removed' ELSE CASE WHEN c_custkey % 7 = 0 THEN 'changed' ELSE 'unchanged' END END AS change, count(*)::BIGINT AS n FROM customer GROUP BY 2
        UNION ALL SELECT 'deductions', CASE c % 10 WHEN 1 THEN 'inserted' WHEN 2 THEN 'removed' ELSE 'unchanged' END, count(*) FROM (SELECT DISTINCT o_custkey AS c, year(o_orderdate) AS y FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 50 = 0) GROUP BY 2""",
    "seed_published": "SELECT year(o_orderdate)::BIGINT AS season_end_year, o_custkey % 3 + 1 AS tier, count(DISTINCT o_custkey)::BIGINT AS n, count(DISTINCT CASE WHEN o_custkey % 10 <> 2 THEN o_custkey END)::BIGINT AS n_named, count(*)::BIGINT AS points FROM orders GROUP BY 1, 2",
    "file_matches": "SELECT season_end_year, tier, count(DISTINCT (match_date, home_id, away_id))::BIGINT AS n, count(DISTINCT home_id)::BIGINT AS homes, min(match_date) AS first, max(match_date) AS last FROM m WHERE l_orderkey % 13 <> 0 GROUP BY 1, 2",
    "file_refresh": """SELECT season_end_year, tier, count(DISTINCT (match_date, home_id, away_id)) FILTER (WHERE l_orderkey % 13 <> 0)::BIGINT AS n, count(DISTINCT home_id) FILTER (WHERE l_orderkey % 13 <> 0)::BIGINT AS homes, min(match_date) FILTER (WHERE l_orderkey % 13 <> 0) AS first,
        max(match_date) FILTER (WHERE l_orderkey % 13 <> 0) AS last, CASE WHEN season_end_year >= 1998 THEN 'live' WHEN season_end_year = 1995 AND bool_or(l_orderkey % 4 = 0) THEN 'new' END AS read_again FROM m GROUP BY 1, 2 HAVING n > 0""",
    "nearest_grounds": """SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY miles, other)::BIGINT AS nth, round(miles, 6) AS miles FROM (
        SELECT a.id, b.id AS other, 3958.8::DOUBLE * 2 * atan2(sqrt(h), sqrt(1 - h)) AS miles FROM spots a JOIN spots b ON a.id <> b.id
        CROSS JOIN LATERAL (SELECT power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2) AS h)) QUALIFY nth <= 3""",
    "order_ranks": """SELECT o_orderkey, season_end_year, value, rank() OVER (PARTITION BY season_end_year ORDER BY value DESC)::BIGINT AS rank, count(*) OVER (PARTITION BY season_end_year)::BIGINT AS published,
        row_number() OVER (PARTITION BY season_end_year ORDER BY o_orderdate, o_orderkey)::BIGINT AS nth FROM (SELECT o_orderkey, o_orderdate, year(o_orderdate)::BIGINT AS season_end_year, floor(o_totalprice / 100)::BIGINT AS value FROM orders)""",
    "order_tiles": """SELECT o_orderkey, season_end_year, tile, row_number() OVER (PARTITION BY season_end_year, tile ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS place, count(*) OVER (PARTITION BY season_end_year, tile)::BIGINT AS n_in_tile
        FROM (SELECT o_orderkey, o_totalprice, year(o_orderdate)::BIGINT AS season_end_year, ntile(7) OVER (PARTITION BY year(o_orderdate) ORDER BY o_totalprice DESC, o_orderkey)::BIGINT AS tile FROM orders)""",
    "cheaper_above": """SELECT a.o_orderkey, (SELECT count(*) FROM orders b WHERE year(b.o_orderdate) = year(a.o_orderdate) AND b.o_custkey % 4 = a.o_custkey % 4 - 1 AND b.o_totalprice < a.o_totalprice)::BIGINT AS beaten FROM orders a WHERE a.o_custkey % 4 > 0""",
    "name_searches": """SELECT term, row_number() OVER (PARTITION BY term ORDER BY key, id)::BIGINT AS nth, id, key FROM namekeys JOIN (SELECT DISTINCT trim(unnest([key[-5:], key[1:2], key[4:n + 3], key[-1:]])) AS term FROM (
        SELECT trim(regexp_replace(lower(s_name), '[^\\p{L}\\p{N}]', ' ', 'g')) AS key, 9 AS n FROM supplier UNION ALL SELECT trim(regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]', ' ', 'g')), 6 FROM part WHERE p_partkey % 10 = 0)) ON contains(key, term) WHERE term <> '' QUALIFY nth <= 8""",
    "account_spells": """SELECT f.club_id, season_end_year, disclosure, s.tier AS spell_tier, "start", "end" FROM fin f LEFT JOIN segs s ON s.club_id = f.club_id AND season_end_year BETWEEN "start" AND "end\"""",
    "shared_spells": """SELECT a.club_id AS pair, a.tier, a."start", a."end", b."start" AS start2, b."end" AS end2 FROM segs a JOIN segs b ON b.club_id = a.club_id + 3 AND a.tier = b.tier AND a."start" <= b."end" AND b."start" <= a."end\"""",
    "rule_intervals": """SELECT g.season_end_year, g.tier, n, total_clubs, down_lo FROM (SELECT year(o_orderdate)::BIGINT AS season_end_year, o_custkey % 6 + 1 AS tier, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2) g
        LEFT JOIN rules r ON r.tier = g.tier AND season_end_year BETWEEN from_year AND to_year QUALIFY row_number() OVER (PARTITION BY g.season_end_year, g.tier ORDER BY from_year DESC NULLS LAST) = 1""",
    "career_refresh": "SELECT r.club_id, current_tier, highest_tier, n_seasons, total_promotions, total_relegations, yo_yo_score, current_tier_streak FROM rollup r JOIN streak s USING (club_id)",
    "top_yo_yo_sql": "SELECT club_id, yo_yo_score, total_promotions, total_relegations, (first_season_in_db - 1) || '/' || lpad((first_season_in_db % 100)::VARCHAR, 2, '0') AS first_season FROM rollup ORDER BY yo_yo_score DESC, club_id LIMIT 10",
}
ORACLE_SQL = {name: sql(text) for name, text in SELECTS.items()}
