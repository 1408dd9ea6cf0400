"""Alert similarity without comparing all pairs.

Two alerts score .30 for an equal process hash, .20 for the rule, .15 each for source and
destination address, .10 for the host and .10 times the Jaccard index of their title
tokens; a field counts only when present on both sides. From .92 they are duplicates,
from .70 related.

Only a few field combinations reach .70, so everything reduces to equality of such
combinations (letters below: hash, rule, source, destination, host ``o``):

* without the title: hrsd, hrso, hrdo, hsdo (and hrsdo);
* with equal token sets: hro, hsd, rsdo;
* with a Jaccard index of at least one half: hrs, hrd.

:func:`related_counts` uses that to give every alert its exact number of duplicates and
related alerts from group sizes, by inclusion and exclusion, without emitting pairs: a
block holding a third of all alerts costs one row per distinct alert profile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import non_empty, picked, title_tokens
from ..session import materialised

FIELDS = {
    "h": "process_hash", "r": "detection_rule", "s": "source_ip", "d": "destination_ip", "o": "hostname",
}
# --- fixed values: feature weights in hundredths, and the two thresholds --------------
WEIGHTS = {"h": 30, "r": 20, "s": 15, "d": 15, "o": 10}
TITLE_WEIGHT = 10
DUPLICATE, RELATED = 0.92, 0.70
# --------------------------------------------------------------------------------------

# Contribution of each combination's group sizes to the number of alerts scoring >= .70:
# (any title, equal title, title Jaccard >= 1/2).
COUNTING = {
    "hrsdo": (-3, 1, 2),
    "hrsd": (1, -1, -2),
    "hrso": (1, -1, -1),
    "hrdo": (1, -1, -1),
    "hsdo": (1, -1, 0),
    "rsdo": (0, 1, 0),
    "hro": (0, 1, 0),
    "hsd": (0, 1, 0),
    "hrs": (0, 0, 1),
    "hrd": (0, 0, 1),
}
# Combinations whose members are all related to each other, and whether the title
# must be equal too.
COHESIVE = {
    "hrsd": False, "hrso": False, "hrdo": False, "hsdo": False,
    "hro": True, "hsd": True, "rsdo": True, "hrs": True, "hrd": True,
}
_SEP = "\u0001"


def _features(alerts: DataFrame, *keep: str) -> DataFrame:
    fields = [non_empty(F.col(name)).alias(letter) for letter, name in FIELDS.items()]
    title = F.array_join(title_tokens(F.col("title")), _SEP).alias("title")
    out = alerts.select(*keep, *fields, title)
    whole = F.concat_ws(_SEP, *[F.coalesce(c, F.lit("")) for c in FIELDS], "title")
    return out.withColumn("profile", F.md5(whole))


def _profiles(features: DataFrame) -> DataFrame:
    """Feature-equal alerts collapsed to one row with their number and smallest id.

    ``title`` is the sorted token set as text, empty when there are no tokens.
    """
    return features.groupBy("profile", *FIELDS, "title").agg(
        F.count(F.lit(1)).alias("n"), F.min("alert_id").alias("alert_id")
    )


def _combination_key(combo: str) -> Column:
    """Group key, or NULL when a field is missing."""
    present = F.lit(True)
    for letter in combo:
        present = present & F.col(letter).isNotNull()
    return F.when(present, F.md5(F.concat_ws(_SEP, F.lit(combo), *combo)))


def _by_combination(profiles: DataFrame, combos, *keep: str) -> DataFrame:
    """One row per profile and combination whose fields it has."""
    groups = F.array(*[F.struct(F.lit(c).alias("combo"), _combination_key(c).alias("key")) for c in combos])
    return (
        profiles.select(*keep, F.explode(groups).alias("g")).select(*keep, "g.combo", "g.key")
        .filter(F.col("key").isNotNull())
    )


def _tokens(title: Column) -> Column:
    return F.when(title != "", F.split(title, _SEP)).otherwise(F.array().cast("array<string>"))


def _overlap(a: Column, b: Column) -> tuple[Column, Column]:
    shared = F.size(F.array_intersect(a, b))
    return shared, F.size(a) + F.size(b) - shared


def similarity(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """Score of two feature sets, keyed by field letter plus ``tokens``."""
    hundredths = F.lit(0)
    for letter, weight in WEIGHTS.items():
        hundredths = hundredths + F.when(left[letter] == right[letter], weight).otherwise(0)
    shared, union = _overlap(left["tokens"], right["tokens"])
    title = F.when(union > 0, shared * TITLE_WEIGHT / union).otherwise(0.0)
    return F.round((hundredths + title) / 100, 6)


_GROUP = ["combo", "key"]


#: Titles of up to so many tokens are counted through their subsets; pairs with a longer one meet.
SHORT = 7


def _needed(m: Column, other: Column, least: Column) -> Column:
    """Tokens two titles of ``m`` and ``other`` tokens must share for an index of 1 / ``least``."""
    return F.ceil((m + other) / (least + 1)).cast("int")


def _counted_titles(titles: DataFrame) -> DataFrame:
    """Sums over a group's other short titles without meeting any of them.

    Each title is listed under every subset of its tokens that may be shared enough; per subset and length
    there is one row, however many titles contain it. From the numbers containing the subsets of a title
    follow, by inclusion and exclusion, the numbers sharing at least so many tokens with it.
    """
    m, mask = F.size("tokens"), F.col("mask")
    listed = (
        titles.where(m <= SHORT).select(*_GROUP, "title", "n_title", "first_id", "tokens", m.alias("m"), F.when(F.col("combo") == "hrsdo", 5).otherwise(2).alias("least"))
        .withColumn("mask", F.explode(F.sequence(F.lit(1), F.expr("shiftleft(1, m) - 1"))))
        .where(F.bit_count(mask) * F.col("least") >= F.col("m"))
        .select(*_GROUP, "title", "n_title", "first_id", "m", "least", F.bit_count(mask).alias("i"), F.expr(f"array_join(filter(tokens, (t, p) -> getbit(mask, p) = 1), '{_SEP}')").alias("subset"))
    )
    holding = listed.groupBy(*_GROUP, "subset", F.col("m").alias("other_m")).agg(F.sum("n_title").alias("n"), F.min("first_id").alias("other_id"))
    near = listed.join(holding, [*_GROUP, "subset"]).where((F.col("m") * F.col("least") >= F.col("other_m")) & (F.col("other_m") * F.col("least") >= F.col("m")))

    def at_least(least: int) -> Column:
        j, i = _needed(F.col("m"), F.col("other_m"), F.lit(least)), F.col("i")
        ways = F.factorial(i - 1) / (F.factorial(j - 1) * F.factorial(i - j))
        signed = F.when((i - j) % 2 == 0, ways).otherwise(-ways)
        return F.sum(F.when(i >= j, F.round(signed).cast("long") * F.col("n")).otherwise(0))

    exact = F.col("i") == _needed(F.col("m"), F.col("other_m"), F.lit(5))
    # A title finds itself, too.
    return near.groupBy(*_GROUP, "title", "n_title").agg(
        at_least(2).alias("n_half"), at_least(5).alias("n_fifth"), F.min(F.when(exact, F.col("other_id"))).alias("near_id")
    ).select(*_GROUP, "title", (F.col("n_half") - F.col("n_title")).alias("n_half"), (F.col("n_fifth") - F.col("n_title")).alias("n_fifth"), "near_id")


def _met_titles(titles: DataFrame) -> DataFrame:
    """The same sums over pairs of which at least one title is long.

    Titles of m and L tokens that share k share one of their m - k + 1 and L - k + 1 rarest of the
    group, so for each other length a title is listed under so many: a token that many long titles have
    is a place to meet only if sharing the rarer ones alone could not suffice.
    """
    m = F.size("tokens")
    sized = titles.select(*_GROUP, "title", "n_title", "first_id", "tokens", m.alias("m"), F.when(F.col("combo") == "hrsdo", 5).otherwise(2).alias("least"))
    long_groups = sized.where(F.col("m") > SHORT).select(*_GROUP).distinct()
    sized = sized.join(long_groups, _GROUP)
    lengths = sized.select(*_GROUP, F.col("m").alias("other_m")).distinct()
    held = sized.select(*_GROUP, F.explode("tokens").alias("token")).groupBy(*_GROUP, "token").agg(F.count(F.lit(1)).alias("held"))
    payload = [*_GROUP, "title", "n_title", "first_id", "m", "least"]
    ranked = (
        sized.select(*payload, F.explode("tokens").alias("token")).join(held, [*_GROUP, "token"])
        .groupBy(*payload).agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("ranked"))
    )
    fits = (F.greatest("m", "other_m") > SHORT) & (F.col("m") * F.col("least") >= F.col("other_m")) & (F.col("other_m") * F.col("least") >= F.col("m"))
    rarest = F.slice("ranked", F.lit(1), F.col("m") - _needed(F.col("m"), F.col("other_m"), F.col("least")) + 1)
    listed = ranked.join(lengths, _GROUP).where(fits).select(*payload, "other_m", F.explode(rarest).alias("r")).select(*payload, "other_m", "r.token")
    other = listed.select(
        *_GROUP, "token", F.col("other_m").alias("m"), F.col("m").alias("other_m"), F.col("title").alias("other_title"),
        F.col("n_title").alias("n"), F.col("first_id").alias("other_id"),
    )
    met = listed.join(other, [*_GROUP, "token", "m", "other_m"]).where("title <> other_title").select(*_GROUP, "title", "other_title", "n", "other_id").distinct()
    shared, union = _overlap(F.split("title", _SEP), F.split("other_title", _SEP))
    fifth = shared * 5 >= union
    return met.groupBy(*_GROUP, "title").agg(
        F.sum(F.when(shared * 2 >= union, F.col("n")).otherwise(0)).alias("n_half"),
        F.sum(F.when(fifth, F.col("n")).otherwise(0)).alias("n_fifth"),
        F.min(F.when(fifth, F.col("other_id"))).alias("near_id"),
    )


def _near_titles(titles: DataFrame) -> DataFrame:
    """Per title of a group: its other titles with Jaccard >= 1/2 and >= 1/5, counted in alerts,
    and the smallest alert id of the latter and itself. Above 1/5 only all five equal fields matter.
    """
    both = _counted_titles(titles).unionByName(_met_titles(titles))
    return both.groupBy(*_GROUP, "title").agg(F.sum("n_half").alias("n_half"), F.sum("n_fifth").alias("n_fifth"), F.min("near_id").alias("near_id"))


def related_counts(alerts: DataFrame) -> DataFrame:
    """Per alert: number of duplicates and of related alerts among all others.

    ``cluster`` is the smallest id among the alert and its duplicates (duplicates always
    share all five fields, so ``matching_features`` names them).
    """
    features = _features(alerts, "alert_id")
    profiles = materialised(_profiles(features), "alert-profiles")
    members = _by_combination(profiles, COUNTING, "profile", "title", "n", "alert_id")

    titles = members.groupBy("combo", "key", "title").agg(F.sum("n").alias("n_title"), F.min("alert_id").alias("first_id"))
    groups = titles.groupBy("combo", "key").agg(
        F.sum("n_title").alias("n_any"), F.count_if(F.col("title") != "").alias("titles")
    )
    sized = materialised(titles.join(groups, ["combo", "key"]), "alert-groups")
    # Different titles matter only where one can tip the balance and a group has several;
    # the rows are distinct titles of a group, not alerts.
    fuzzy = [c for c, (_, _, half) in COUNTING.items() if half]
    several = sized.filter(F.col("combo").isin(*fuzzy) & (F.col("titles") > 1) & (F.col("title") != ""))
    near = _near_titles(several.select("combo", "key", "title", "n_title", "first_id", F.split("title", _SEP).alias("tokens")))
    has_title = F.col("title") != ""
    equal = F.when(has_title, F.col("n_title")).otherwise(0)
    half = equal + F.coalesce("n_half", F.lit(0))
    fifth = equal + F.coalesce("n_fifth", F.lit(0))
    score = F.lit(0)
    for combo, (any_, same, fuzzy_) in COUNTING.items():
        score = F.when(
            F.col("combo") == combo, any_ * F.col("n_any") + same * equal + fuzzy_ * half
        ).otherwise(score)
    contributions = sized.join(near, ["combo", "key", "title"], "left").select(
        "combo", "key", "title", score.alias("at_least_related"),
        F.when(F.col("combo") == "hrsdo", fifth).otherwise(0).alias("at_least_duplicate"),
        F.when((F.col("combo") == "hrsdo") & has_title, F.least("first_id", "near_id")).alias("cluster"),
    )
    per_profile = (
        members.select("profile", "combo", "key", "title")
        .join(contributions, ["combo", "key", "title"])
        .groupBy("profile")
        .agg(F.sum("at_least_related").alias("related_all"), F.sum("at_least_duplicate").alias("duplicate_all"), F.min("cluster").alias("cluster"))
    )
    own = F.lit(0)
    for letter, weight in WEIGHTS.items():
        own = own + F.when(F.col(letter).isNotNull(), weight).otherwise(0)
    own = own + F.when(has_title, TITLE_WEIGHT).otherwise(0)
    self_related, self_duplicate = (own >= 70).cast("int"), (own >= 92).cast("int")
    duplicates = F.coalesce("duplicate_all", F.lit(0)) - self_duplicate
    related = F.coalesce("related_all", F.lit(0)) - self_related - duplicates
    total = profiles.agg(F.sum("n") - 1).scalar()
    names = F.array(*[F.lit(v) for v in FIELDS.values()])
    judged = (
        profiles.join(per_profile, "profile", "left")
        .select("profile", "cluster", duplicates.alias("duplicates"), related.alias("related"))
    )
    return features.select("alert_id", "profile").join(judged, "profile").select(
        "alert_id", F.coalesce("cluster", "alert_id").alias("cluster"), "duplicates", "related",
        total.alias("total_compared"), F.when(F.col("duplicates") > 0, names).alias("matching_features"),
    )


def anchored_scores(alerts: DataFrame) -> DataFrame:
    """Similarity of each alert profile to the anchor of every cohesive group it is in.

    The rows form stars, one per group: any two alerts that reach .70 by field or title
    equality are members of a common group, so the groups hold all such pairs in linear space.
    """
    profiles = materialised(_profiles(_features(alerts, "alert_id")), "alert-profiles")
    payload = ["alert_id", "n", *FIELDS, "title"]
    members = _by_combination(profiles, COHESIVE, *payload)
    with_title = F.col("combo").isin(*[c for c, title in COHESIVE.items() if title])
    members = members.filter(~with_title | (F.col("title") != "")).withColumn(
        "key", F.when(with_title, F.md5(F.concat_ws(_SEP, "key", "title"))).otherwise(F.col("key"))
    )
    groups = (
        members.groupBy("combo", "key")
        .agg(
            F.min(F.struct("alert_id", *FIELDS, "title")).alias("a"), F.sum("n").alias("group_size"),
            F.count(F.lit(1)).alias("profiles"),
        )
        .filter(F.col("profiles") > 1)
    )
    joined = members.join(groups, ["combo", "key"]).filter(F.col("alert_id") != F.col("a.alert_id"))
    score = similarity(
        {**{x: F.col(x) for x in FIELDS}, "tokens": _tokens(F.col("title"))},
        {**{x: F.col(f"a.{x}") for x in FIELDS}, "tokens": _tokens(F.col("a.title"))},
    )
    return joined.select(
        "combo", F.col("a.alert_id").alias("anchor_id"), "alert_id", F.col("n").alias("equal_alerts"), "group_size",
        score.alias("similarity"),
    )


# Blocks that together hold every pair reaching .70.
_BLOCKS = ("hrs", "hrd", "hro", "hsd", "rsdo")


def similar_to(queries: DataFrame, candidates: DataFrame, minimum: float = RELATED) -> DataFrame:
    """Candidates similar to given query alerts, with score, kind and matching features.

    The query alerts are the caller's (new alerts of one batch, say), so the result is as
    long as their matches. Each pair is scored once: in the first block it shares.
    """
    q = _features(queries, "alert_id").select(F.col("alert_id").alias("query_id"), *[F.col(c).alias(f"q_{c}") for c in [*FIELDS, "title"]])
    c = _features(candidates, "alert_id").select("alert_id", *FIELDS, "title")
    pairs = None
    for i, block in enumerate(_BLOCKS):
        on = F.lit(True)
        for letter in block:
            on = on & (F.col(f"q_{letter}") == F.col(letter))
        earlier = F.lit(False)
        for done in _BLOCKS[:i]:
            same = F.lit(True)
            for letter in done:
                same = same & F.coalesce(F.col(f"q_{letter}") == F.col(letter), F.lit(False))
            earlier = earlier | same
        part = q.join(c, on).filter(~earlier & (F.col("query_id") != F.col("alert_id")))
        pairs = part if pairs is None else pairs.unionByName(part)
    score = similarity(
        {**{x: F.col(f"q_{x}") for x in FIELDS}, "tokens": _tokens(F.col("q_title"))},
        {**{x: F.col(x) for x in FIELDS}, "tokens": _tokens(F.col("title"))},
    )
    matching = picked([F.when(F.col(f"q_{x}") == F.col(x), F.lit(name)) for x, name in FIELDS.items()])
    return (
        pairs.withColumn("similarity", score)
        .filter(F.col("similarity") >= minimum)
        .select(
            "query_id", "alert_id", "similarity",
            F.when(F.col("similarity") >= DUPLICATE, "duplicate").otherwise("related").alias("kind"),
            F.when(F.col("similarity") >= DUPLICATE, matching).alias("matching_features"),
        )
    )
