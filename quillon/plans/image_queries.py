"""Image hashes and similarity on integer matrices; embeddings of 64 numbers serve as 8 x 8 images.

A tenth of the images is added once more, turned or mirrored, so that the thresholds of near duplicates fire.
"""

from __future__ import annotations

import functools

from quillon.plans.dialect import DUCK, SPARK, Spark, both

#: The symmetries of the square, as (row, column) of the source of pixel (r, c) in an 8 x 8 image.
SYMMETRIES = {
    "identity": "r * 8 + c", "rot90": "c * 8 + 7 - r", "rot180": "(7 - r) * 8 + 7 - c", "rot270": "(7 - c) * 8 + r",
    "flip_h": "r * 8 + 7 - c", "flip_v": "(7 - r) * 8 + c", "transpose": "c * 8 + r", "transverse": "(7 - c) * 8 + 7 - r",
}
#: Bits in which near duplicates differ at most; a hash of 64 bits has THRESHOLD + 1 bands, of which one is equal then.
THRESHOLD, BANDS = 6, 7
#: Signs in which tiles of two images differ at most.
TILE_THRESHOLD = 4


def _permuted(d: Spark, name: str, image: str = "px") -> str:
    at = SYMMETRIES[name].replace("r", "intdiv_r").replace("c", "mod_c")
    if d.spark:
        at = at.replace("intdiv_r", "(i div 8)").replace("mod_c", "(i % 8)")
        return f"transform(sequence(0, 63), i -> element_at({image}, cast({at} + 1 as int)))"
    at = at.replace("intdiv_r", "(i // 8)").replace("mod_c", "(i % 8)")
    return f"list_transform(range(64), lambda i: {image}[({at} + 1)::int])"


def _images(d: Spark) -> str:
    px = f"{d.transform}(embedding, {d.fn('x', f'cast(floor(x * 1000) as bigint)')})"
    case = " ".join(f"when {k} then {_permuted(d, n)}" for k, n in enumerate(SYMMETRIES))
    return f"""raw as (select cast(vec_id as bigint) as id, {px} as px from embeddings where embedding is not null and {d.size}(embedding) = 64),
images as (select id, px from raw union all select id + 1000000 as id, case (id % 80) {'div' if d.spark else '//'} 10 {case} end as px from raw where id % 10 = 0)"""


def _sum(d: Spark, values: str) -> str:
    return f"aggregate({values}, cast(0 as bigint), (a, x) -> a + x)" if d.spark else f"cast(list_sum({values}) as bigint)"


def _bits(d: Spark, condition: str) -> str:
    """A 64-bit number of the places 0..63 (variable i) where the condition holds; the last place is the sign."""
    if d.spark:
        return f"aggregate(sequence(0, 63), cast(0 as bigint), (a, i) -> if({condition}, a | shiftleft(cast(1 as bigint), i), a))"
    return f"list_reduce(list_transform(range(64), lambda i: case when {condition} then case when i = 63 then (-9223372036854775808)::bigint else (1::bigint << i::int) end else 0::bigint end), lambda a, b: a | b)"


def _falls(pick) -> str:
    """Whether a row falls from column c to the next, drawn out to nine columns: column j of nine holds j parts of pixel j - 1 and 8 - j of pixel j."""
    return f"(i % 8) * {pick('greatest(i, 1)')} + (7 - 2 * (i % 8)) * {pick('i + 1')} - (7 - i % 8) * {pick('least(i + 2, 64)')} > 0"


def _hashes(d: Spark) -> str:
    pick = (lambda i: f"element_at(px, cast({i} as int))") if d.spark else (lambda i: f"px[({i})::int]")
    average = _bits(d, f"{pick('i + 1')} * 64 >= total")
    difference = _bits(d, _falls(pick))
    return f"{_images(d)}, totals as (select id, px, {_sum(d, 'px')} as total from images), hashes as (select id, px, {average} as a, {difference} as d from totals)"


def sc80_hamming(d: Spark) -> str:
    """Distance of the average hashes of neighbouring images."""
    return f"with {_hashes(d)} select x.id, cast({d.xor('x.a', 'y.a')} as bigint) as distance from hashes x join hashes y on y.id = x.id + 1"


def sc81_hashes(d: Spark) -> str:
    return f"with {_hashes(d)} select id, a as average_hash, d as difference_hash from hashes"


def sc84_symmetries(d: Spark) -> str:
    """Each image under the eight symmetries."""
    per = " union all ".join(f"select id, '{n}' as symmetry, {_permuted(d, n)} as p from raw" for n in SYMMETRIES)
    return f"with {_images(d)}, per as ({per}) select id, symmetry, {d.join(f'{d.transform}(p, {d.fn(chr(120), f'cast(x as {d.text})')})', ',')} as pixels from per"


def sc85_luma(d: Spark) -> str:
    return f"with {_images(d)}, p as (select id, {d.unnest('px')} as v from images) select id, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as deviation from p group by id"


def _dot(d: Spark, a: str, b: str) -> str:
    if d.spark:
        return f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), cast(0 as double), (s, v) -> s + v)"
    return f"list_dot_product({a}, {b})"


def sc86_correlation(d: Spark) -> str:
    """Centred cosine of neighbouring images, at most 1; 0 or 1 where an image is flat."""
    mean = f"({_sum(d, 'px')} / 64.0)"
    centred = f"{d.transform}(px, {d.fn('v', 'cast(v as double) - m')})"
    e = _dot(d, "cast(x.z as double[])" if not d.spark else "x.z", "cast(y.z as double[])" if not d.spark else "y.z")
    norm = lambda t: _dot(d, f"{t}.z", f"{t}.z")
    return f"""with {_images(d)}, m as (select id, px, {mean} as m from images), c as (select id, px, {centred} as z from m),
j as (select x.id, x.px = y.px as same, {e} as xy, {norm('x')} as xx, {norm('y')} as yy from c x join c y on y.id = x.id + 1)
select id, round(case when xx = 0 or yy = 0 then case when same then 1.0 else 0.0 end else greatest(-1.0, least(1.0, xy / sqrt(xx * yy))) end, 6) as correlation from j"""


def _bounds(x: str, y: str, gap: int) -> str:
    return f"not ({x}.x1 + {gap} <= {y}.x0 or {y}.x1 + {gap} <= {x}.x0 or {x}.y1 + {gap} <= {y}.y0 or {y}.y1 + {gap} <= {x}.y0)"


def sc87_overlapping_regions(d: Spark) -> str:
    rows = [(1, 0, 0, 64, 64), (2, 60, 60, 100, 100), (3, 70, 0, 128, 50), (4, 200, 200, 264, 264), (5, 264, 200, 300, 264)]
    return f"with {d.values('v', 'id, x0, y0, x1, y1', rows)} select a.id as a, b.id as b, {_bounds('a', 'b', 0)} as overlaps, {_bounds('a', 'b', 16)} as near from v a join v b on a.id < b.id"


def sc88_merged_region(d: Spark) -> str:
    rows = [(1, 0, 0, 64, 64), (1, 60, 60, 100, 100), (2, 70, 0, 128, 50)]
    return f"""with {d.values('v', 'img, x0, y0, x1, y1', rows)}, u as (select img, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1 from v group by img)
select img, x0, y0, x1, y1, round(cast((x1 - x0) * (y1 - y0) as double) / 65536, 6) as fraction from u"""


def sc89_displacement(d: Spark) -> str:
    """Displacements in bins of 32 pixels, halves to the even bin."""
    rows = [(1, 16, 48), (2, -16, 80), (3, 15, 33), (4, -47, -49), (5, 112, 0)]
    even = "bround" if d.spark else "round_even"
    zero = "" if d.spark else ", 0"
    return f"with {d.values('v', 'id, dx, dy', rows)} select id, cast({even}(dx / 32.0{zero}) * 32 as bigint) as bx, cast({even}(dy / 32.0{zero}) * 32 as bigint) as by_ from v"


def _turned(d: Spark) -> str:
    turned = " union all ".join(f"select id, '{n}' as symmetry, {k} as k, {_permuted(d, n)} as px from images" for k, n in enumerate(SYMMETRIES))
    return f"{_images(d)}, turned as ({turned})"


def _basis() -> str:
    """What each pixel of an 8 x 8 image, drawn out four times, adds to each low frequency but the constant, as a list of lists."""
    from quillon.operators.images import cosine_basis

    b = cosine_basis().reshape(8, 8, 4).sum(2)
    return "[" + ", ".join("[" + ", ".join(repr(float(b[k, r] * b[m, c])) for r in range(8) for c in range(8)) + "]" for k in range(8) for m in range(8) if k or m) + "]"


_LOW = f"list_transform({_basis()}, lambda w: list_dot_product(w, cast(px as double[])))"


def _perceptual_sql() -> str:
    return "list_reduce(list_transform(range(63), lambda i: case when low[(i + 1)::int] >= list_sort(low)[32] then 1::bigint << (62 - i)::int else 0::bigint end), lambda a, b: a | b)"


def _near_pairs(d: Spark) -> str:
    """Pairs of images with a hash at most THRESHOLD bits away under a symmetry of the right one.

    Each hash is cut into one band more than the bits that may differ, so near hashes agree in a band; equal bands are joined, not all pairs.
    The perceptual hash comes from the view turned_perceptual, in the SQL for comparison from dot products.
    """
    methods = ("a", "d", "p")
    own, both_ = ", ".join(methods), ", ".join(f"l.{m} as l{m}, r.{m} as r{m}" for m in methods)
    perceptual = ", p from totals left join turned_perceptual on code = id * 8 + k" if d.spark else f", {_perceptual_sql()} as p from (select *, {_LOW} as low from totals)"
    band = lambda m, b: f"(({f'shiftright({m}, {b * 9})' if d.spark else f'({m} >> {b * 9})'}) & {1023 if b == BANDS - 1 else 511})"
    made = [(m, b, band(m, b)) for m in methods for b in range(BANDS)]
    bands = d.array(*[f"struct('{m}' as method, {b} as band, {v} as v)" if d.spark else f"{{'method': '{m}', 'band': {b}, 'v': {v}}}" for m, b, v in made])
    pick = (lambda i: f"element_at(px, cast({i} as int))") if d.spark else (lambda i: f"px[({i})::int]")
    a, df = _bits(d, f"{pick('i + 1')} * 64 >= total"), _bits(d, _falls(pick))
    return f"""{_turned(d)}, totals as (select id, symmetry, k, px, {_sum(d, 'px')} as total from turned),
hashed as (select id, symmetry, k, {a} as a, {df} as d{perceptual}), banded as (select id, symmetry, k, {own}, {d.unnest(bands)} as b from hashed),
keys as (select id, symmetry, k, {own}, b.method as method, b.band as band, b.v as v from banded),
cand as (select distinct l.id as left_id, r.id as right_id, r.symmetry, r.k, {both_} from keys l join keys r on l.method = r.method and l.band = r.band and l.v = r.v where l.k = 0 and l.id < r.id),
dist as (select left_id, right_id, symmetry, k, least({', '.join(d.xor(f'l{m}', f'r{m}') for m in methods)}) as distance from cand),
best as (select left_id, right_id, symmetry, cast(distance as bigint) as distance, row_number() over (partition by left_id, right_id order by distance, k) as rn from dist where distance <= {THRESHOLD}),
edges as (select left_id, right_id, symmetry, distance from best where rn = 1)"""


def j02_near_images(d: Spark) -> str:
    return f"with {_near_pairs(d)} select * from edges"


def j05_undeclared_images(d: Spark) -> str:
    """Near images without those of declared pairs (each third image and its copy is declared)."""
    return f"""with {_near_pairs(d)}, declared as (select id as x, id + 1000000 as y from raw where id % 3 = 0)
select e.left_id, e.right_id, e.distance from edges e left join declared on least(x, y) = left_id and greatest(x, y) = right_id where x is null"""


def _tiles(d: Spark) -> str:
    """4 x 4 tiles of every image at a stride of two, with their mean and deviation."""
    spots = [(x, y) for y in range(0, 5, 2) for x in range(0, 5, 2)]
    cells = lambda x, y: ", ".join(f"px[{(y + r) * 8 + x + c + (0 if d.spark else 1)}]" for r in range(4) for c in range(4))
    make = ", ".join((f"struct({x} as x0, {y} as y0, array({cells(x, y)}) as t)" if d.spark else f"{{'x0': {x}, 'y0': {y}, 't': [{cells(x, y)}]}}") for x, y in spots)
    z = f"{d.transform}(t, {d.fn('v', 'cast(v as double) - m')})"
    return f"""{_images(d)}, cut as (select id, {d.unnest(f'array({make})' if d.spark else f'[{make}]')} as s from images), flat as (select id, s.x0 as x0, s.y0 as y0, s.t as t from cut),
means as (select id, x0, y0, t, {_sum(d, 't')} / 16.0 as m from flat), tiles as (select id, x0, y0, {z} as z from means)"""


def j04_tiles_within(d: Spark) -> str:
    """Pairs of tiles of one image that don't overlap and correlate at 0.8 or more."""
    return f"""with {_tiles(d)}, j as (select a.id, a.x0 as ax, a.y0 as ay, b.x0 as bx, b.y0 as by_, {_dot(d, 'a.z', 'b.z')} / sqrt({_dot(d, 'a.z', 'a.z')} * {_dot(d, 'b.z', 'b.z')}) as c
from tiles a join tiles b on a.id = b.id and (a.y0 < b.y0 or (a.y0 = b.y0 and a.x0 < b.x0)) where (abs(a.x0 - b.x0) >= 4 or abs(a.y0 - b.y0) >= 4) and {_dot(d, 'a.z', 'a.z')} > 0 and {_dot(d, 'b.z', 'b.z')} > 0)
select id, ax, ay, bx, by_, round(c, 6) as correlation from j where c >= 0.8"""


def j03_tiles_across(d: Spark) -> str:
    """The best matching tile pair of each pair of images with tiles that correlate at 0.985 or more and differ in at most TILE_THRESHOLD signs.

    Scaled to length 1, two such tiles have a squared distance of at most 0.03. Places of unlike signs add the squares of both tiles to it,
    so in one of the two tiles the squares of these places sum to half of it at most: every tile is looked up under its signs with each such
    set of weak places turned, which finds every pair. The SQL for comparison still joins equal signs.
    """
    if not d.spark:
        cells = "list_transform(z, lambda v: case when v > 0 then '1' else '0' end)"
        return f"""with {_tiles(d)}, signs as (select id, x0, y0, z, {d.join(cells, '')} as s from tiles),
j as (select a.id as left_id, b.id as right_id, {_dot(d, 'a.z', 'b.z')} / sqrt({_dot(d, 'a.z', 'a.z')} * {_dot(d, 'b.z', 'b.z')}) as c from signs a join signs b on a.s = b.s and a.id < b.id where {_dot(d, 'a.z', 'a.z')} > 0 and {_dot(d, 'b.z', 'b.z')} > 0)
select left_id, right_id, count(*) as n_tiles, round(max(c), 6) as best from j where c >= 0.985 group by left_id, right_id"""
    half = "zz * 0.015000001"  # with room for rounding
    turn = f"filter(transform(acc, e -> named_struct('s', e.s ^ shiftleft(1, i), 'w', e.w + z[i] * z[i], 'n', e.n + 1)), e -> e.w <= {half} and e.n <= {TILE_THRESHOLD})"
    probes = f"aggregate(sequence(0, 15), array(named_struct('s', s, 'w', cast(0 as double), 'n', 0)), (acc, i) -> if(z[i] * z[i] > {half}, acc, concat(acc, {turn})))"
    return f"""with {_tiles(d)}, lengths as (select id, x0, y0, z, {_dot(d, 'z', 'z')} as zz from tiles),
signs as (select *, aggregate(sequence(0, 15), 0, (m, i) -> if(z[i] > 0, m | shiftleft(1, i), m)) as s from lengths where zz > 0),
probes as (select id, x0, y0, z, zz, explode({probes}) as p from signs),
j as (select a.id as ai, a.x0 as ax, a.y0 as ay, b.id as bi, b.x0 as bx, b.y0 as by_, {_dot(d, 'a.z', 'b.z')} / sqrt(a.zz * b.zz) as c from probes a join signs b on a.p.s = b.s and a.id <> b.id),
once as (select distinct least(ai, bi) as left_id, greatest(ai, bi) as right_id, if(ai < bi, array(ax, ay, bx, by_), array(bx, by_, ax, ay)) as at, c from j where c >= 0.985)
select left_id, right_id, count(*) as n_tiles, round(max(c), 6) as best from once group by left_id, right_id"""


def t04_tile_sample(d: Spark) -> str:
    """Every image's place in an even sample of 100, halves to the even place."""
    even, zero = ("bround", "") if d.spark else ("round_even", ", 0")
    seq = "explode(sequence(0, 99))" if d.spark else "unnest(range(100))"
    return f"with n as (select count(*) as n from embeddings), k as (select {seq} as k, n from n) select distinct cast({even}(k * (n - 1) / 99.0{zero}) as bigint) as place from k"


def w06_budget(d: Spark) -> str:
    """Pairs of groups in order until a budget of comparisons is used up."""
    return """with g as (select label, count(*) as n from embeddings group by label), p as (select a.label as l, b.label as r, a.n * b.n as cost from g a join g b on a.label < b.label),
run as (select l, r, cost, sum(cost) over (order by l, r rows between unbounded preceding and current row) as used from p) select l, r, cost, cast(used as bigint) as used, used <= 10000 as within from run"""


def t05_representative_edge(d: Spark) -> str:
    """The least edge of each image's near pairs, by distance, then ids."""
    return f"with {_near_pairs(d)}, r as (select *, row_number() over (partition by left_id order by distance, left_id, right_id) as rn from edges) select left_id, right_id, distance from r where rn = 1"


QUERIES, SQL = both([
    sc80_hamming, sc81_hashes, sc84_symmetries, sc85_luma, sc86_correlation, sc87_overlapping_regions, sc88_merged_region, sc89_displacement,
    j02_near_images, j03_tiles_across, j04_tiles_within, j05_undeclared_images, t04_tile_sample, t05_representative_edge, w06_budget,
])


def _with_perceptual(query):
    """A query over near pairs, with the perceptual hashes of all turned images at hand; matrix algebra, so no SQL."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        from quillon.operators.images import perceptual_hashes
        from quillon.session import table

        table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
        turned = spark.sql(f"with {_turned(SPARK)} select id * 8 + k as id, px from turned")
        perceptual_hashes(turned).toDF("code", "p").createOrReplaceTempView("turned_perceptual")
        return query(spark, sf_dir)

    return run


QUERIES |= {n: _with_perceptual(QUERIES[n]) for n in ("j02_near_images", "j05_undeclared_images", "t05_representative_edge")}


def g01_image_clusters(spark, sf_dir):
    """Clusters of near images: (image, cluster), the cluster named by its least image."""
    from quillon.operators.graph import components
    from quillon.session import materialise

    edges = materialise(QUERIES["j02_near_images"](spark, sf_dir), "near-images")
    return components(edges.selectExpr("left_id as src", "right_id as dst")).toDF("image", "cluster")


def g02_image_cluster_summary(spark, sf_dir):
    """Per cluster its number of images and edges and the closest edge."""
    from pyspark.sql import functions as F

    from quillon.operators.graph import components
    from quillon.session import materialise

    edges = materialise(QUERIES["j02_near_images"](spark, sf_dir), "near-images")
    nodes = components(edges.selectExpr("left_id as src", "right_id as dst")).toDF("left_id", "cluster")
    members = nodes.groupBy("cluster").agg(F.count("*").alias("n_images"))
    own = edges.join(nodes, "left_id").groupBy("cluster").agg(F.count("*").alias("n_edges"), F.min(F.struct("distance", "left_id", "right_id")).alias("e"))
    return members.join(own, "cluster").select("cluster", "n_images", "n_edges", F.col("e.left_id").alias("left_id"), F.col("e.right_id").alias("right_id"))


def sc83_perceptual_hashes(spark, sf_dir):
    """Perceptual hashes of all embeddings as images; matrix algebra, so no SQL."""
    from quillon.operators.images import perceptual_hashes
    from quillon.session import table

    return perceptual_hashes(table(spark, sf_dir, "embeddings").selectExpr("vec_id as id", "embedding as px"))


QUERIES |= {"sc83_perceptual_hashes": sc83_perceptual_hashes, "g01_image_clusters": g01_image_clusters, "g02_image_cluster_summary": g02_image_cluster_summary}

_REACH = f"""with recursive {_near_pairs(DUCK)}, sym as (select left_id as a, right_id as b from edges union select right_id, left_id from edges),
reach(a, b) as (select a, b from sym union select reach.a, sym.b from reach join sym on sym.a = reach.b), label as (select a as image, least(a, min(b)) as cluster from reach group by a)"""
SQL |= {
    "sc83_perceptual_hashes": f"select id, {_perceptual_sql()} as p from (select vec_id as id, {_LOW.replace('px', 'embedding')} as low from embeddings where len(embedding) = 64)",
    "g01_image_clusters": f"{_REACH} select image, cluster from label",
    "g02_image_cluster_summary": f"""{_REACH}, e as (select cluster, left_id, right_id, distance, count(*) over (partition by cluster) as n_edges, row_number() over (partition by cluster order by distance, left_id, right_id) as k from edges join label on image = left_id)
select cluster, n_images, n_edges, left_id, right_id from e join (select cluster, count(*) as n_images from label group by 1) using (cluster) where k = 1""",
}
