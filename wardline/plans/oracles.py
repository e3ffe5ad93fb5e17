"""DuckDB statements that compute the same results by independent means.

Built from shared table expressions: ``access`` (the event view), ``features``, ``scored`` and
``results``. They use frames, self joins and recursion where the Spark side uses running sums.
"""

from __future__ import annotations

from wardline.config import CLASSES, FEATURES, FeatureConfig
from wardline.functions.wording import STRENGTH_CAP
from wardline.plans.results import TEST_CONFIG
from wardline.sources.events import SPOOFED


def r(x: str, digits: int) -> str:
    return f"(floor(({x}) * {float(10 ** digits)} + 0.500001) / {float(10 ** digits)})"


def pct(key: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % 100)"


def access() -> dict[str, str]:
    return {
        "raw_access": """
            SELECT event_id, ts, epoch_us(ts) AS us, user_id, event_type, value,
                   CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
                   CAST(user_id % 5 AS INT) AS g FROM events""",
        "typed_access": f"""
            SELECT *, 'd' || g AS dept,
              CAST(CASE WHEN k < 70 THEN g * 18 + k % 9 WHEN k < 85 THEN 90 + k % 10
                   ELSE (k * 7 + user_id) % 90 END AS INT) AS host,
              CASE WHEN event_id % 53 = 0 THEN -event_id - 1 ELSE user_id * 2 + k % 2 END AS device_id,
              CASE WHEN event_id % 41 = 0 THEN '{SPOOFED}' END AS spoofed_fingerprint,
              CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status,
              CAST(CASE WHEN event_id % 37 = 0 THEN 6 + user_id % 9 ELSE g END AS INT) AS city_id,
              CASE WHEN event_id % 41 = 0 THEN 'device_spoofing' WHEN event_id % 37 = 0 THEN 'impossible_travel'
                   WHEN event_id % 53 = 0 THEN 'credential_misuse'
                   WHEN event_type = 'error' AND value > 100 THEN 'brute_force'
                   WHEN k >= 97 THEN 'lateral_movement' END AS attack_type
            FROM raw_access""",
        "access": f"""
            SELECT event_id, ts, us, user_id, dept, host, device_id, spoofed_fingerprint, status, attack_type,
              CASE WHEN attack_type IS NULL THEN 'normal' ELSE 'attack' END AS label,
              CASE WHEN attack_type IS NOT NULL
                   THEN attack_type || '_' || user_id || '_' || strftime(ts, '%Y-%m-%d') END AS attack_id,
              'place' || city_id AS geo_city, (city_id * 37 % 121 - 60.25)::DOUBLE AS geo_lat,
              (city_id * 83 % 331 - 165.5)::DOUBLE AS geo_lon, 'land' || city_id % 7 AS geo_country,
              user_id % 14 = 13 AS is_cold_start, user_id % 3 = 0 AS drift_group,
              CASE WHEN host >= 90 THEN 'shared' ELSE 'd' || CAST(floor(host / 18.0) AS INT) END AS owner_dept,
              CASE WHEN spoofed_fingerprint IS NOT NULL THEN 'os9|br9|sc9'
                   WHEN device_id >= 0 THEN 'os' || device_id % 5 || '|br' || device_id % 4 || '|sc' || device_id % 4
              END AS fp,
              hour(ts) + minute(ts) / 60.0::DOUBLE AS hr
            FROM typed_access""",
    }


def edges() -> dict[str, str]:
    return {
        "owned_hosts": "SELECT DISTINCT host AS src FROM access WHERE host < 90",
        "one_way": """
            SELECT src, CAST(floor(src / 18.0) * 18 + (src % 18 + 1) % 18 AS INT) AS dst, 'intra_dept' AS kind
            FROM owned_hosts
            UNION ALL SELECT src, 90 + src % 10, 'shared_link' FROM owned_hosts WHERE src % 3 = 0""",
        "links": """
            SELECT src, dst, max(kind) AS kind FROM
            (SELECT * FROM one_way UNION ALL SELECT dst, src, kind FROM one_way) GROUP BY ALL""",
    }


def distance_ctes(sources: str = "SELECT DISTINCT host FROM access") -> dict[str, str]:
    return {
        "walk(src, dst, d)": f"""
            SELECT host, host, 0 FROM ({sources})
            UNION
            SELECT w.src, l.dst, w.d + 1 FROM walk w JOIN links l ON l.src = w.dst WHERE w.d < 40""",
        "dist": "SELECT src, dst, min(d) AS d FROM walk GROUP BY ALL",
    }


def circular(n: str, s: str, c: str) -> tuple[str, str]:
    """Mean and deviation in hours from the sums of sines and cosines."""
    angle = f"(atan2(({s}) / ({n}), ({c}) / ({n})) / (2 * pi() / 24))"
    length = f"least(greatest(sqrt(pow(({s}) / ({n}), 2) + pow(({c}) / ({n}), 2)), 1e-6), 1.0)"
    mean = f"((({angle}) % 24 + 24) % 24)"
    std = f"greatest(sqrt(-2 * ln({length})) / (2 * pi() / 24), 0.5)"
    return f"CASE WHEN ({n}) > 0 THEN {mean} END", f"CASE WHEN ({n}) > 0 THEN {std} END"


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    chord = (f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
             f"cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))")
    return f"(asin(sqrt(CASE WHEN {chord} > 1 THEN 1.0 ELSE {chord} END)) * 12742.0)"


def features(cfg: FeatureConfig = TEST_CONFIG) -> dict[str, str]:
    lateral, failure = cfg.lateral_window_s * 1_000_000, cfg.failure_window_s * 1_000_000
    p_mean, p_std = circular("least(k_est, %d)" % cfg.dept_history, "dsin", "dcos")
    u_mean, u_std = circular("least(n, %d)" % cfg.hour_history, "usin", "ucos")
    angle = "(hr * (2 * pi() / 24))"
    order = "ORDER BY us, event_id"
    out = access() | edges() | distance_ctes()
    out |= {
        "f1": f"""
            SELECT *, NOT is_cold_start AS est,
              CAST(owner_dept <> dept AND owner_dept <> 'shared' AS INT) AS is_foreign_dept,
              count(*) FILTER (NOT is_cold_start) OVER (PARTITION BY dept {order}
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k_est,
              row_number() OVER w - 1 AS n,
              first_value(us) OVER w AS us0, lag(us) OVER w AS pus, lag(geo_lat) OVER w AS plat,
              lag(geo_lon) OVER w AS plon,
              row_number() OVER (PARTITION BY user_id, device_id {order}) AS dev_n,
              row_number() OVER (PARTITION BY user_id, host {order}) AS host_n,
              row_number() OVER (PARTITION BY user_id, owner_dept {order}) AS dept_n,
              sum(sin({angle})) OVER h AS usin, sum(cos({angle})) OVER h AS ucos
            FROM access
            WINDOW w AS (PARTITION BY user_id {order}),
                   h AS (PARTITION BY user_id {order} ROWS BETWEEN {cfg.hour_history} PRECEDING AND 1 PRECEDING)""",
        "f2": f"""
            SELECT *,
              sum(CASE WHEN est THEN sin({angle}) ELSE 0 END) OVER p AS dsin,
              sum(CASE WHEN est THEN cos({angle}) ELSE 0 END) OVER p AS dcos
            FROM f1 WINDOW p AS (PARTITION BY dept ORDER BY k_est
              RANGE BETWEEN {cfg.dept_history} PRECEDING AND 1 PRECEDING)""",
        "f3": f"""
            SELECT *, coalesce({p_mean}, {cfg.default_mean_hour}) AS pm, coalesce({p_std}, {cfg.default_std_hour}) AS ps,
              {u_mean} AS um, {u_std} AS usd, least(1.0, n / {float(cfg.min_history)}) AS w FROM f2""",
        "f4": """
            SELECT *, coalesce(w * um + (1 - w) * pm, pm) AS mh, coalesce(w * usd + (1 - w) * ps, ps) AS sh FROM f3""",
        "fp_counts": """
            SELECT a.event_id, b.fp, count(*) AS c, min({'us': b.us, 'id': b.event_id}) AS f
            FROM access a JOIN access b ON a.device_id = b.device_id AND b.fp IS NOT NULL
              AND (b.us, b.event_id) < (a.us, a.event_id) GROUP BY ALL""",
        "fp_mode": """
            SELECT event_id, fp AS mode_fp FROM fp_counts
            QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY c DESC, f) = 1""",
        "bursts": f"""
            SELECT a.event_id,
              count(DISTINCT b.owner_dept) FILTER (b.is_foreign_dept = 1 AND b.us >= a.us - {lateral}) AS fdb,
              count(*) FILTER (b.host_n = 1 AND b.us >= a.us - {lateral}) AS nhb,
              count(*) FILTER (b.status = 'failure' AND b.us >= a.us - {failure}) AS fb
            FROM f1 a JOIN f1 b ON a.user_id = b.user_id AND (b.us, b.event_id) < (a.us, a.event_id)
            GROUP BY ALL""",
        "reach": f"""
            SELECT a.event_id, min(coalesce(d.d, {cfg.unreachable})) AS g
            FROM f1 a JOIN f1 b ON a.user_id = b.user_id AND a.host_n = 1 AND b.host_n = 1
              AND (b.us, b.event_id) < (a.us, a.event_id)
            LEFT JOIN dist d ON d.src = a.host AND d.dst = b.host GROUP BY ALL""",
        "features": f"""
            SELECT a.event_id, ts, user_id, dept, host, device_id, status, label, attack_type, attack_id,
              {r("least((abs(hr - mh) % 24), 24 - (abs(hr - mh) % 24)) / greatest(sh, 0.5)", 3)} AS hour_zscore,
              coalesce({r(haversine("plat", "plon", "geo_lat", "geo_lon"), 2)}, 0.0) AS geo_distance_km,
              coalesce({r(haversine("plat", "plon", "geo_lat", "geo_lon")
                          + " / greatest((us - pus) / 1000000.0::DOUBLE / 3600, 1.0::DOUBLE / 60)", 2)}, 0.0)
                AS geo_velocity_kmh,
              {r("(us - pus) / 1000000.0::DOUBLE / 60", 2)} AS time_since_last_event_min,
              CAST(dev_n = 1 AS INT) AS is_new_device,
              CAST(coalesce(a.fp IS NOT NULL AND mode_fp IS NOT NULL AND a.fp <> mode_fp, false) AS INT)
                AS fingerprint_mismatch,
              CAST(host_n = 1 AS INT) AS is_new_host, is_foreign_dept,
              CAST(dept_n = 1 AND is_foreign_dept = 1 AS INT) AS is_first_time_in_this_dept,
              CAST(coalesce(fdb, 0) AS INT) AS foreign_dept_burst_distinct,
              CAST(coalesce(nhb, 0) AS INT) AS new_host_burst_count,
              CAST(coalesce(g, 0) AS INT) AS graph_dist_from_history,
              CAST(coalesce(fb, 0) AS INT) AS failure_burst_count,
              {r("(us - us0) / 86400000000.0::DOUBLE", 2)} AS entity_history_days,
              CAST(n AS INT) AS entity_history_event_count,
              CAST(n < {cfg.min_history} AS INT) AS is_cold_start_entity,
              {r("w", 2)} AS cold_start_blend_weight
            FROM f4 a LEFT JOIN fp_mode USING (event_id) LEFT JOIN bursts USING (event_id)
              LEFT JOIN reach USING (event_id)""",
    }
    return out


def strength(f: str) -> str:
    cap = STRENGTH_CAP.get(f)
    if cap is None:
        return f"CAST(coalesce({f}, 0) AS DOUBLE)"
    if f == "time_since_last_event_min":
        return f"(1 - least(coalesce({f}, {cap}), {cap}) / {float(cap)}::DOUBLE)"
    v = f"abs({f})" if f == "hour_zscore" else f
    return f"(least(CAST(coalesce({v}, 0) AS DOUBLE), {float(cap)}::DOUBLE) / {float(cap)}::DOUBLE)"


def scored() -> dict[str, str]:
    parts = [strength(f) for f in FEATURES]
    first = " + ".join(parts)
    second = " + ".join([f"{parts[0]} * {parts[0]}"] + [
        f"{p} * {p} * {float(i + 2)}::DOUBLE" for i, p in enumerate(parts[1:])])
    return features() | {
        "tagged": f"""
            SELECT *, {r(first, 6)} AS iso_raw, {r(second, 6)} AS ae_raw,
              CASE WHEN label <> 'normal' THEN 'attack' WHEN {pct('event_id')} < 70 THEN 'train_normal'
                   ELSE 'holdout_normal' END AS split FROM features""",
        "ref_size": "SELECT count(*) AS nref FROM tagged WHERE split = 'train_normal'",
        "rank1": """SELECT s.iso_raw, 100.0::DOUBLE * count(t.event_id) / max(nref) AS p1
            FROM (SELECT DISTINCT iso_raw FROM tagged) s CROSS JOIN ref_size
            LEFT JOIN tagged t ON t.split = 'train_normal' AND t.iso_raw <= s.iso_raw GROUP BY 1""",
        "rank2": """SELECT s.ae_raw, 100.0::DOUBLE * count(t.event_id) / max(nref) AS p2
            FROM (SELECT DISTINCT ae_raw FROM tagged) s CROSS JOIN ref_size
            LEFT JOIN tagged t ON t.split = 'train_normal' AND t.ae_raw <= s.ae_raw GROUP BY 1""",
        "ens": f"""SELECT t.*, {r('p1', 2)} AS iso_forest_score, {r('p2', 2)} AS autoencoder_score,
              {r('(p1 + p2) / 2', 2)} AS ensemble_score_raw
            FROM tagged t JOIN rank1 USING (iso_raw) JOIN rank2 USING (ae_raw)""",
        "dept_ref": """SELECT dept, quantile_cont(ensemble_score_raw, 0.5) AS ref_score FROM ens
            WHERE label = 'normal' AND is_cold_start_entity = 0 GROUP BY dept""",
        "global_ref": """SELECT quantile_cont(ensemble_score_raw, 0.5) AS general FROM ens
            WHERE label = 'normal' AND is_cold_start_entity = 0""",
        "scored": f"""SELECT e.*, {r('''least(greatest(cold_start_blend_weight * ensemble_score_raw
              + (1 - cold_start_blend_weight) * coalesce(ref_score, general), 0.0), 100.0)''', 2)} AS final_risk_score
            FROM ens e LEFT JOIN dept_ref USING (dept) CROSS JOIN global_ref""",
    }


def results(rule: str = "mean") -> dict[str, str]:
    weights = [f"(instr('0123456789abcdef', substr(md5(CAST(event_id AS VARCHAR)), {i + 1}, 1)) + "
               f"CASE WHEN target = '{c}' THEN 24 ELSE 0 END)::DOUBLE" for i, c in enumerate(CLASSES)]
    total = " + ".join(f"w{i}" for i in range(len(CLASSES)))
    unified = {"mean": "(final_risk_score + classifier_attack_prob) / 2",
               "max": "greatest(final_risk_score, classifier_attack_prob)"}[rule]
    options = " UNION ALL ".join(
        f"SELECT event_id, {i} AS i, '{c}' AS cls, w{i} / tot AS p, "
        + {"brute_force": "failure_burst_count >= 1", "device_spoofing": "fingerprint_mismatch >= 1"}.get(c, "true")
        + " AS ok FROM probs" for i, c in enumerate(CLASSES))
    return scored() | {
        "sessions": """SELECT attack_id, min(attack_type) AS attack_type FROM access
            WHERE attack_id IS NOT NULL GROUP BY 1""",
        "placed": """SELECT attack_id, row_number() OVER (PARTITION BY attack_type ORDER BY md5(attack_id), attack_id)
              - 1 AS rk, ceil(count(*) OVER (PARTITION BY attack_type) * 0.2) AS fifth FROM sessions""",
        "session_split": """SELECT attack_id, CASE WHEN rk < fifth THEN 'test' WHEN rk < 2 * fifth THEN 'val'
              ELSE 'train' END AS s FROM placed""",
        "targets": f"""SELECT c.*, coalesce(attack_type, 'normal') AS target,
              coalesce(s, CASE WHEN {pct('event_id')} < 20 THEN 'test' WHEN {pct('event_id')} < 40 THEN 'val'
                          ELSE 'train' END) AS clf_split
            FROM scored c LEFT JOIN session_split USING (attack_id)""",
        "weights": "SELECT *, " + ", ".join(f"{w} AS w{i}" for i, w in enumerate(weights)) + " FROM targets",
        "probs": f"SELECT *, {total} AS tot FROM weights",
        "options": options,
        "chosen": """SELECT event_id, cls AS pred_label, p AS confidence FROM options WHERE ok
            QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p DESC, i) = 1""",
        "ungated": """SELECT event_id, cls AS raw_label, p AS raw_confidence FROM options
            QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY p DESC, i) = 1""",
        "predicted": f"""SELECT p.*, pred_label, confidence, raw_label, raw_confidence,
              1 - w{CLASSES.index('normal')} / tot AS attack_prob,
              nullif(pred_label, 'normal') AS predicted_attack_type,
              {r('confidence', 4)} AS classifier_confidence,
              {r(f"(1 - w{CLASSES.index('normal')} / tot) * 100", 2)} AS classifier_attack_prob
            FROM probs p JOIN chosen USING (event_id) JOIN ungated USING (event_id)""",
        "results": f"""SELECT *, {r(unified, 2)} AS unified_risk_score,
              (predicted_attack_type IS NULL AND final_risk_score >= 98) AS secondary_review_flag FROM predicted""",
    }


def chance(*parts: str) -> str:
    """A number in [0, 1) from 52 bits of the MD5 of the parts joined by colons."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 13) AS BIGINT) / {2.0 ** 52}::DOUBLE)"


def isolation(n_trees: int = 300, sample: int = 256, seed: int = 42) -> dict[str, str]:
    """The forest grown again from the feature table, one level of all trees a step, and ``iso_walk``: a path length per event and tree."""
    depth = (sample - 1).bit_length()
    n = len(FEATURES)
    wanted = f"(1.5::DOUBLE * {n_trees * sample} / greatest(n, 1))"
    fills = ", ".join(f"(SELECT quantile_cont({f}, 0.5) FROM tagged WHERE split = 'train_normal') AS m{i}" for i, f in enumerate(FEATURES))
    values = ", ".join(f"coalesce({f}, m{i})::DOUBLE" for i, f in enumerate(FEATURES))
    spans = ", ".join(f"{agg}(xs[{i}]) AS {agg}{i}" for i in range(1, n + 1) for agg in ("min", "max"))
    lows, highs = (", ".join(f"{agg}{i}" for i in range(1, n + 1)) for agg in ("min", "max"))
    out = {
        "fills": f"SELECT {fills}",
        "vectors": f"SELECT event_id, split, [{values}] AS xs FROM tagged CROSS JOIN fills",
        "iso_size": "SELECT count(*) AS n FROM vectors WHERE split = 'train_normal'",
        "dealt": f"""SELECT DISTINCT event_id, xs, CASE WHEN {wanted} >= {n_trees} THEN copy - 1
              ELSE CAST(floor({chance(str(seed), "'tree'", 'event_id', 'copy')} * {n_trees}) AS INT) END AS tree
            FROM (SELECT *, unnest(range(1, CAST(CASE WHEN {wanted} >= {n_trees} THEN {n_trees} ELSE ceil({wanted}) END AS INT) + 1)) AS copy
                  FROM vectors CROSS JOIN iso_size WHERE split = 'train_normal'
                    AND ({wanted} >= 1 OR {chance(str(seed), "'row'", 'event_id')} < {wanted}))""",
        "rows0": f"""SELECT tree, 1 AS place, event_id, xs FROM dealt QUALIFY row_number() OVER
            (PARTITION BY tree ORDER BY md5(concat_ws(':', {seed}, 'order', tree, event_id)), event_id) <= {sample}""",
        "tree_size": "SELECT tree, count(*) AS size FROM rows0 GROUP BY 1",
    }
    for d in range(depth + 1):
        out[f"spans{d}"] = f"SELECT tree, place, count(*) AS c, {spans} FROM rows{d} GROUP BY 1, 2"
        out[f"usable{d}"] = f"""SELECT tree, place, c, lows, highs, CASE WHEN 2 ** {d} < size AND c > 1
              THEN list_filter(range(1, {n + 1}), lambda i: highs[i] > lows[i]) ELSE [] END AS usable
            FROM (SELECT tree, place, c, [{lows}] AS lows, [{highs}] AS highs FROM spans{d}) JOIN tree_size USING (tree)"""
        out[f"picked{d}"] = f"""SELECT *, CASE WHEN len(usable) > 0 THEN
              usable[1 + CAST(floor({chance(str(seed), "'feature'", 'tree', 'place')} * len(usable)) AS INT)] END AS f FROM usable{d}"""
        out[f"nodes{d}"] = f"""SELECT tree, place, f, CASE WHEN t <= lows[f] THEN highs[f] ELSE t END AS t,
              {d} + CASE WHEN c <= 1 THEN 0 WHEN c = 2 THEN 1
                    ELSE 2 * (ln(c - 1) + 0.5772156649015329::DOUBLE) - 2.0::DOUBLE * (c - 1) / c END AS len
            FROM (SELECT *, lows[f] + {chance(str(seed), "'threshold'", 'tree', 'place')} * (highs[f] - lows[f]) AS t FROM picked{d})"""
        if d < depth:
            out[f"rows{d + 1}"] = f"""SELECT r.tree, 2 * r.place + CAST(r.xs[k.f] >= k.t AS INT) AS place, r.event_id, r.xs
                FROM rows{d} r JOIN nodes{d} k ON k.tree = r.tree AND k.place = r.place AND k.f IS NOT NULL"""
    steps = " ".join(f"LEFT JOIN nodes{d} k{d} ON k{d}.tree = k0.tree AND k{d}.place = 2 * k{d - 1}.place + "
                     f"CAST(v.xs[k{d - 1}.f] >= k{d - 1}.t AS INT)" for d in range(1, depth + 1))
    reached = ", ".join(f"k{d}.len" for d in range(depth, -1, -1))
    return out | {"iso_walk": f"SELECT v.event_id, v.split, sum(coalesce({reached})) AS total, count(*) AS trees "
                              f"FROM vectors v CROSS JOIN nodes0 k0 {steps} GROUP BY 1, 2"}


def sql(ctes: dict[str, str], query: str) -> str:
    head = "RECURSIVE " if any("(" in name for name in ctes) else ""
    # Materialised: the chains are long and their parts are used several times.
    body = ", ".join(f"{name} AS {'' if '(' in name else 'MATERIALIZED '}({text})" for name, text in ctes.items())
    return f"WITH {head}{body} {query}"
