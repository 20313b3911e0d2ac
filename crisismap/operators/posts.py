"""Post shaping, filters and dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crisismap.functions import sphere as SPH
from crisismap.schemas import POST_COLUMNS

EXTERNAL = "app.bsky.embed.external"
IMAGES = "app.bsky.embed.images"
EMPTY = "CAST(array() AS ARRAY<STRING>)"

# Region rectangle of the flood study (F4), closed edges.
EUROPE_BOX = (1.40625, 35.746512, 32.695313, 57.04073)


def parse_posts(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Flatten nested raw posts to the 17-column post row; missing parents give NULL."""
    thumbs = F.expr("filter(transform(coalesce(embed.images, array()), x -> x.thumb), u -> u IS NOT NULL AND u <> '')")
    fulls = F.expr("filter(transform(coalesce(embed.images, array()), x -> x.fullsize), u -> u IS NOT NULL AND u <> '')")
    embed_urls = F.expr(
        f"""CASE WHEN record.embed.`$type` = '{EXTERNAL}' THEN
                   CASE WHEN coalesce(record.embed.external.uri, '') <> '' THEN array(record.embed.external.uri)
                        ELSE {EMPTY} END
                 WHEN record.embed.`$type` = '{IMAGES}' THEN
                   transform(filter(coalesce(record.embed.images, array()), i -> i.image.ref.`$link` IS NOT NULL),
                             i -> i.image.ref.`$link`)
                 ELSE {EMPTY} END""")
    facet_urls = F.expr(
        "filter(flatten(transform(coalesce(record.facets, array()), f -> "
        "transform(coalesce(f.features, array()), g -> g.uri))), u -> u IS NOT NULL AND u <> '')")
    return raw.select(
        "cid", "uri",
        F.col("author.displayName").alias("author_displayName"),
        F.col("author.handle").alias("author_handle"),
        F.col("author.did").alias("author_did"),
        F.col("record.createdAt").alias("createdAt"),
        F.col("record.langs").alias("langs"),
        F.col("record.text").alias("text"),
        "replyCount", "repostCount", "likeCount", "quoteCount",
        F.col("record.reply.parent.cid").alias("reply_parent_cid"),
        F.col("record.reply.root.cid").alias("reply_root_cid"),
        thumbs.alias("image_thumbnails"),
        fulls.alias("image_fullsizes"),
        F.concat(embed_urls, facet_urls).alias("urls"),
        *keep,
    ).select(*POST_COLUMNS, *keep)


def ensure_cleaned(df: DataFrame, text: str = "text", decode: bool = True) -> DataFrame:
    """P10: keep an existing ``cleaned_text``, else derive it from ``text`` (T1), else fail."""
    from crisismap.functions.text import clean_text

    if "cleaned_text" in df.columns:
        return df
    if text not in df.columns:
        raise ValueError("input needs a 'cleaned_text' or a 'text' column")
    return df.withColumn("cleaned_text", clean_text(text, decode=decode))


def language_code(langs: str = "langs") -> Column:
    """First language cut to two characters; NULL when the list is empty or missing."""
    return F.substring(F.get(F.col(langs), 0), 1, 2)


def with_language(df: DataFrame, langs: str = "langs") -> DataFrame:
    return df.withColumn("language", language_code(langs))


def with_media_flags(df: DataFrame) -> DataFrame:
    """P5: any url containing 'http'; any thumbnail."""
    return df.withColumn(
        "contains_external_url",
        F.expr("coalesce(exists(urls, u -> coalesce(contains(u, 'http'), false)), false)")
    ).withColumn("contains_image", F.expr("coalesce(size(image_thumbnails), 0) > 0"))


def with_places(df: DataFrame, toponyms: str = "toponyms") -> DataFrame:
    """Place names of the toponyms."""
    return df.withColumn("place", F.expr(f"transform(coalesce({toponyms}, array()), t -> t.text)"))


def points_of(toponyms: str = "toponyms") -> Column:
    """Multipoint of resolved toponyms; either coordinate NULL drops the point, duplicates stay."""
    return F.expr(
        f"transform(filter(coalesce({toponyms}, array()), t -> t.longitude IS NOT NULL AND t.latitude IS NOT NULL),"
        f" t -> named_struct('lon', t.longitude, 'lat', t.latitude))")


def with_points(df: DataFrame, toponyms: str = "toponyms") -> DataFrame:
    return df.withColumn("points", points_of(toponyms))


def explode_points(df: DataFrame, points: str = "points") -> DataFrame:
    """One row per point (inner explode: empty multipoints vanish)."""
    return df.select("*", F.explode(points).alias("pt")).select(
        "*", F.col("pt.lon").alias("lon"), F.col("pt.lat").alias("lat")).drop("pt")


def non_empty_text(df: DataFrame, text: str = "text", legacy: bool = False) -> DataFrame:
    """drop empty texts. ``legacy=True`` keeps NULL texts as the reference did ('None' string)."""
    if legacy:
        return df.where(F.coalesce(F.col(text) != "", F.lit(True)))
    return df.where(F.col(text) != "")


def disaster_related(df: DataFrame, col: str = "disaster_related") -> DataFrame:
    """F2."""
    return df.where(F.col(col) == 1)


def has_geometry(points: str = "points") -> Column:
    """multipoint not empty."""
    return F.coalesce(F.size(F.col(points)) > 0, F.lit(False))


def in_box(points: str = "points", box: tuple = EUROPE_BOX) -> Column:
    """any point of the post inside the closed rectangle (lon0, lat0, lon1, lat1)."""
    x0, y0, x1, y1 = box
    return F.coalesce(F.expr(
        f"exists({points}, p -> p.lon BETWEEN {x0}D AND {x1}D AND p.lat BETWEEN {y0}D AND {y1}D)"), F.lit(False))


def in_sphere_box(points: str = "points", box: tuple = EUROPE_BOX) -> Column:
    """F4 on the sphere: as ``in_box``, but the sides between the corners are great circles."""
    return SPH.any_inside(points, [SPH.box_ring(box)])


def frequent_values(df: DataFrame, col: str, min_count: int = 100) -> DataFrame:
    """values occurring more than ``min_count`` times (HAVING)."""
    return (df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > min_count))


def dedupe_keep_first(df: DataFrame, key: str = "cid", order: str = "crawl_seq") -> DataFrame:
    """Keep the first row per key in crawl order.

    A grouped ``min_by`` instead of a ``row_number`` window: the aggregate is
    combined map-side, so a key holding a third of all rows is reduced before
    the shuffle instead of landing whole in one task. A NULL order counts after
    all others.
    """
    others = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*others), F.struct(F.col(order).isNull(), F.col(order)))
    return df.groupBy(key).agg(best.alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def dataset_summary(df: DataFrame, points: str = "points", related: str = "disaster_related") -> DataFrame:
    """Posts, with geometry, related, related with geometry — one pass."""
    geo = has_geometry(points)
    rel = F.coalesce(F.col(related) == 1, F.lit(False))
    return df.agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_if(geo).alias("with_geometry"),
        F.count_if(rel).alias("related"),
        F.count_if(geo & rel).alias("related_with_geometry"))


def concat_tables(*dfs: DataFrame) -> DataFrame:
    """Union by name, missing columns as NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def unpivot_labels(df: DataFrame, ids: list[str], labels: list[str], name: str = "label",
                   value: str = "count") -> DataFrame:
    """Wide label columns to long rows."""
    return df.unpivot(ids, labels, name, value)


def label_display(c, mapping: dict[str, str]) -> Column:
    """Display names by a literal map."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), F.col(c) if isinstance(c, str) else c)
