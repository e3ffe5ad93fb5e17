"""Plain-language sentences and fallback strengths for alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.scalars import round_to


def _whole(v: Column) -> Column:
    return v.cast("long").cast("string")


def _one_decimal(v: Column) -> Column:
    return F.format_string("%.1f", round_to(v, 1))


def _thousands(v: Column) -> Column:
    return F.format_number(round_to(v, 0), 0)


def _flag(v: Column, yes: str, no: str) -> Column:
    return F.when(v >= 1, F.lit(yes)).otherwise(F.lit(no))


def factor_sentence(feature: Column, v: Column) -> Column:
    """What the value of a feature means, independent of the direction of its effect."""
    # The wording analysts see.
    text = {
        "hour_zscore": F.concat(F.lit("login timing is "), _one_decimal(v),
                                F.lit(" standard deviations from this user's typical hours")),
        "geo_distance_km": F.concat(_thousands(v), F.lit(" km from the previous login's location")),
        "geo_velocity_kmh": F.concat(F.lit("implied travel speed of "), _thousands(v),
                                     F.lit(" km/h between consecutive logins")),
        "time_since_last_event_min": F.concat(F.lit("only "), _one_decimal(v),
                                              F.lit(" minutes since this user's last activity")),
        "is_new_device": _flag(v, "device never seen for this user before",
                               "device this user has used before"),
        "fingerprint_mismatch": _flag(
            v, "device's OS/browser/screen fingerprint doesn't match its known history",
            "device fingerprint matches its known history"),
        "is_new_host": _flag(v, "host never accessed by this user before",
                             "host this user has accessed before"),
        "is_foreign_dept": _flag(
            v, "host belongs to a department outside the user's home department",
            "host is within the user's home department (or shared infrastructure)"),
        "is_first_time_in_this_dept": _flag(v, "user's first-ever access to this specific department",
                                            "user has accessed this department before"),
        "foreign_dept_burst_distinct": F.concat(
            _whole(v), F.lit(" distinct foreign departments touched in the last 15 minutes")),
        "new_host_burst_count": F.concat(
            _whole(v), F.lit(" never-before-seen hosts touched in the last 15 minutes")),
        "graph_dist_from_history": F.when(v > 0, F.concat(
            F.lit("this host is "), _whole(v),
            F.lit(" network hop(s) from anywhere this user has been before"))).otherwise(
            F.lit("this host is directly adjacent to (or is) somewhere this user has been before")),
        "failure_burst_count": F.concat(_whole(v), F.lit(" failed login attempts in the last 5 minutes")),
    }
    chain = None
    for name, sentence in text.items():
        chain = F.when(feature == name, sentence) if chain is None else chain.when(feature == name, sentence)
    return chain.otherwise(F.concat(feature, F.lit("="), v.cast("string")))


def direction_phrase(effect: Column, strong: float = 1.0, moderate: float = 0.3) -> Column:
    size = F.abs(effect)
    strength = F.when(size > strong, "strongly").when(size > moderate, "moderately").otherwise("slightly")
    return F.concat(strength, F.when(effect > 0, " increased suspicion").otherwise(" reduced suspicion"))


def full_sentence(feature: Column, v: Column, effect: Column, predicted: Column) -> Column:
    return F.concat(factor_sentence(feature, v), F.lit(" ("), direction_phrase(effect),
                    F.lit(" of "), predicted, F.lit(")"))


# Feature -> value at which the fallback strength saturates.
STRENGTH_CAP = {
    "hour_zscore": 5,
    "geo_distance_km": 5000,
    "geo_velocity_kmh": 2000,
    "time_since_last_event_min": 60,
    "foreign_dept_burst_distinct": 4,
    "new_host_burst_count": 5,
    "graph_dist_from_history": 3,
    "failure_burst_count": 5,
}


def fallback_strength(feature: str) -> Column:
    """Strength in 0..1 of one feature column, used where no model attribution is at hand."""
    v = F.col(feature)
    cap = STRENGTH_CAP.get(feature)
    if cap is None:
        return F.coalesce(v, F.lit(0)).cast("double")
    if feature == "time_since_last_event_min":
        return 1 - F.least(F.coalesce(v, F.lit(cap)), F.lit(cap)) / float(cap)
    if feature == "hour_zscore":
        v = F.abs(v)
    return F.least(F.coalesce(v, F.lit(0)).cast("double"), F.lit(float(cap))) / float(cap)


def alert_label(user: Column, predicted: Column, risk: Column) -> Column:
    return F.concat(user.cast("string"), F.lit(" · "), predicted, F.lit(" · risk="),
                    _one_decimal(risk))
