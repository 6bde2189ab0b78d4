"""Naming, typing and text queries."""

from pyspark.sql import functions as F

from firmament.dims import vocab as V
from firmament.functions import kinds, names
from firmament.queries.kit import case_sql, catalog, define_view, in_sql, query, rounded, s6, table, values_sql, view

C = F.col

OTYPES = sorted(set(V.OTYPE_GLOSS) | set(V.OTYPE_CATEGORY) | set(V.OTYPE_FEATURE) | set(V.NON_OPTICAL) | {"??", "GlC?", "WR?", "HII?", "zz"})
# Every object-type code, assigned to catalogue rows in turn.
define_view("v_types", f"""
SELECT obj_id, CASE obj_id % {len(OTYPES)} """ + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(OTYPES)) + " END AS otype, obj_id AS o FROM v_catalog")


def types(spark, sf):
    return view(spark, sf, "v_types")


CAT = f"coalesce({case_sql('trim(otype)', V.OTYPE_CATEGORY)}, CASE WHEN contains(trim(otype), '*') THEN 'star' END)"


@query("is_optical", f"SELECT obj_id, trim(otype) NOT IN {in_sql(V.NON_OPTICAL)} AS optical FROM v_types")
def is_optical(spark, sf):
    return types(spark, sf).select("obj_id", kinds.is_optical(C("otype")).alias("optical"))


@query("object_category", f"SELECT obj_id, {CAT} AS category FROM v_types")
def object_category(spark, sf):
    return types(spark, sf).select("obj_id", kinds.object_category(C("otype")).alias("category"))


@query("feature_for_otype", f"SELECT obj_id, {case_sql('otype', V.OTYPE_FEATURE)} AS feature_type FROM v_types")
def feature_for_otype(spark, sf):
    return types(spark, sf).select("obj_id", kinds.feature_for_otype(C("otype")).alias("feature_type"))


ZH, EN = {k: v[0] for k, v in V.OTYPE_GLOSS.items()}, {k: v[1] for k, v in V.OTYPE_GLOSS.items()}
BASE = "rtrim(otype, '?')"


def gloss_sql(table_, suffix):
    return f"coalesce({case_sql('otype', table_)}, CASE WHEN ends_with(otype, '?') THEN {case_sql(BASE, table_)} || '{suffix}' END)"


@query("otype_label", f"SELECT obj_id, {gloss_sql(ZH, '(候选)')} AS zh, {gloss_sql(EN, ' (cand.)')} AS en FROM v_types")
def otype_label(spark, sf):
    return types(spark, sf).select("obj_id", kinds.otype_label(C("otype")).alias("l")).select("obj_id", "l.zh", "l.en")


CZH, CEN = {k: v[0] for k, v in V.CATEGORY.items()}, {k: v[1] for k, v in V.CATEGORY.items()}


@query("object_type_label", f"""
SELECT obj_id, coalesce(CASE WHEN category = 'star' THEN {gloss_sql(ZH, '(候选)')} END, {case_sql('category', CZH)}) AS zh,
 coalesce(CASE WHEN category = 'star' THEN {gloss_sql(EN, ' (cand.)')} END, {case_sql('category', CEN)}) AS en FROM (SELECT *, {CAT} AS category FROM v_types)""")
def object_type_label(spark, sf):
    d = types(spark, sf).withColumn("category", kinds.object_category(C("otype")))
    return d.select("obj_id", kinds.object_type_label(C("otype"), C("category")).alias("l")).select("obj_id", "l.zh", "l.en")


@query("kind_of", f"""SELECT obj_id, CASE WHEN c = 'star' THEN 'star' WHEN c LIKE '%cluster' THEN 'cluster' WHEN c = 'galaxy' THEN 'galaxy' ELSE 'nebula' END AS kind
FROM (SELECT obj_id, {CAT} AS c FROM v_types) WHERE c IS NOT NULL""")
def kind_of(spark, sf):
    d = types(spark, sf).withColumn("category", kinds.object_category(C("otype"))).where("category IS NOT NULL")
    return d.select("obj_id", kinds.kind_of(C("category")).alias("kind"))


@query("has_recognizable_name", f"""
SELECT obj_id, messier IS NOT NULL OR ngc IS NOT NULL OR sharpless IS NOT NULL OR NOT regexp_matches(main_id, '{V.SURVEY_NAME}') AS ok FROM v_cat""")
def has_recognizable_name(spark, sf):
    return catalog(spark, sf).select("obj_id", names.has_recognizable_name(C("main_id"), C("names"), C("catalog_ids"), F.lit(False)).alias("ok"))


@query("is_visible", """
SELECT c.obj_id, CASE WHEN c.mag IS NULL OR category = 'star' THEN TRUE WHEN category = 'dark_nebula' THEN c.mag < 5 * CAST(0.92 AS DOUBLE) ELSE c.mag > 5 * CAST(1.12 AS DOUBLE) END AS visible
FROM v_catalog c JOIN (SELECT obj_id, """ + CAT.replace("trim(otype)", "otype") + """ AS category FROM v_catalog) k USING (obj_id) WHERE category IS NOT NULL""")
def is_visible(spark, sf):
    d = catalog(spark, sf).withColumn("category", kinds.object_category(C("otype"))).where("category IS NOT NULL")
    return d.select("obj_id", kinds.is_visible(C("category"), F.lit(False), C("mag"), F.lit(5.0)).alias("visible"))


@query("identity_confidence", f"SELECT obj_id, {s6('CASE WHEN messier IS NOT NULL THEN 0.97 WHEN ngc IS NOT NULL THEN 0.9 WHEN sharpless IS NOT NULL THEN 0.82 WHEN mag IS NOT NULL THEN 0.85 ELSE 0.7 END')} AS c FROM v_cat")
def identity_confidence(spark, sf):
    return rounded(catalog(spark, sf).select("obj_id", kinds.identity_confidence(C("catalog_ids"), C("mag")).alias("c")))


MECH = ["supernova_remnant", "planetary_nebula", "galaxy"]


@query("resolve_type", f"""
SELECT obj_id, CASE WHEN final <> 'star' THEN {case_sql('final', CZH)} END AS zh0, source, final AS category, {s6("CASE WHEN source <> 'wiki' AND final = 'emission_nebula' THEN 0.4 ELSE 0.7 END")} AS type_confidence,
 source <> 'wiki' AND final = 'emission_nebula' AS type_needs_review
FROM (SELECT obj_id, coalesce(CASE WHEN obj_id % 9 = 0 THEN 'supernova_remnant' END, c) AS final,
  CASE WHEN obj_id % 9 = 0 THEN 'wiki' WHEN obj_id % 5 = 1 THEN 'vizier' ELSE 'simbad' END AS source FROM (SELECT obj_id, {CAT} AS c FROM v_catalog) WHERE c IS NOT NULL)""")
def resolve_type(spark, sf):
    d = catalog(spark, sf).withColumn("category", kinds.object_category(C("otype"))).where("category IS NOT NULL")
    wiki = F.when(C("obj_id") % 9 == 0, F.struct(F.lit("supernova_remnant").alias("category"), F.lit(None).cast("string").alias("zh"), F.lit(None).cast("string").alias("en")))
    src = F.when(C("obj_id") % 5 == 1, "VizieR:x").otherwise(C("source"))
    d = d.select("obj_id", kinds.resolve_type(C("otype"), C("category"), src, wiki).alias("t"))
    # A star's Chinese type follows its object code and is checked elsewhere.
    return rounded(d.select("obj_id", F.when(C("t.category") != "star", C("t.zh")).alias("zh0"), "t.source", "t.category", "t.type_confidence", "t.type_needs_review"))


@query("distance_to_ly", """
SELECT l_orderkey, l_linenumber, l_partkey, floor(l_quantity * CASE l_partkey % 5 WHEN 0 THEN 3.26156 WHEN 1 THEN 3261.56 WHEN 2 THEN 3261560.0 WHEN 3 THEN 1 END + 0.5) AS ly FROM lineitem""".replace("CASE l_partkey", "CAST(CASE l_partkey").replace("THEN 1 END", "THEN 1 END AS DOUBLE)"))
def distance_to_ly(spark, sf):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("pc", "kpc", "Mpc", "ly", "furlong")]), (C("l_partkey") % 5 + 1).cast("int"))
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", kinds.distance_to_ly(C("l_quantity"), unit).alias("ly")))


@query("designations", """
SELECT obj_id, CASE WHEN n > 0 THEN array_to_string(ids, '|') ELSE regexp_replace(main_id, '^\\* +', '') END AS d
FROM (SELECT obj_id, main_id, list_filter([messier, ngc, sharpless], lambda x: x IS NOT NULL) AS ids, len(list_filter([messier, ngc, sharpless], lambda x: x IS NOT NULL)) AS n FROM v_cat)""")
def designations(spark, sf):
    d = catalog(spark, sf).withColumn("main_id", F.when(F.size("catalog_ids") == 0, F.concat(F.lit("*  "), C("main_id"))).otherwise(C("main_id")))
    return d.select("obj_id", F.array_join(names.designations(C("catalog_ids"), C("main_id")), "|").alias("d"))


@query("designations_rest", """
SELECT obj_id, array_to_string(list_filter([messier, ngc, sharpless], lambda x: x IS NOT NULL AND x <> main_id), ' / ') AS rest FROM v_cat""")
def designations_rest(spark, sf):
    return catalog(spark, sf).select("obj_id", names.designations_rest(F.map_values("catalog_ids"), C("main_id")).alias("rest"))


@query("catalog_ids_from_name", """
SELECT obj_id, CASE obj_id % 4 WHEN 0 THEN 'messier' WHEN 1 THEN 'ngc' WHEN 2 THEN 'ic' END AS k,
 CASE obj_id % 4 WHEN 0 THEN concat('M', obj_id) WHEN 1 THEN concat('NGC ', obj_id) WHEN 2 THEN concat('IC ', obj_id) END AS v FROM v_catalog""")
def catalog_ids_from_name(spark, sf):
    o = C("obj_id")
    name = F.when(o % 4 == 0, F.concat(F.lit("M  "), o)).when(o % 4 == 1, F.concat(F.lit("ngc"), o)).when(o % 4 == 2, F.concat(F.lit(" IC   "), o)).otherwise(F.concat(F.lit("HD "), o))
    e = F.map_entries(names.catalog_ids_from_name(name))
    d = view(spark, sf, "v_catalog").select("obj_id", F.try_element_at(e, F.lit(1)).alias("e"))
    return d.select("obj_id", C("e.key").alias("k"), C("e.value").alias("v"))


@query("normalize_id", "SELECT doc_id, upper(replace(regexp_replace(text, '\\s+', '', 'g'), 'ß', 'ss')) AS n FROM documents")
def normalize_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.normalize_id(C("text")).alias("n"))


@query("normalize_designation", "SELECT p_partkey, upper(trim(regexp_replace(concat('  ', p_name, '   ', p_type, ' '), '\\s+', ' ', 'g'))) AS n FROM part")
def normalize_designation(spark, sf):
    return table(spark, sf, "part").select("p_partkey", names.normalize_designation(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type", F.lit(" "))).alias("n"))


@query("atlas_to_pipeline_type", f"SELECT p_partkey, coalesce({case_sql('t', V.ATLAS_TYPE)}, 'emission_color_region') AS feature_type FROM (SELECT p_partkey, CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(V.ATLAS_TYPE)) + " ELSE 'other' END AS t FROM part)")
def atlas_to_pipeline_type(spark, sf):
    t = F.coalesce(F.try_element_at(F.array(*[F.lit(k) for k in V.ATLAS_TYPE]), (C("p_partkey") % 12 + 1).cast("int")), F.lit("other"))
    return table(spark, sf, "part").select("p_partkey", kinds.atlas_to_pipeline_type(t).alias("feature_type"))


@query("annotation_name", """
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_type WHEN 2 THEN p_type ELSE concat('柱状/象鼻 ', p_size) END AS zh,
 CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_type ELSE concat('Pillar ', p_size) END AS en FROM part""")
def annotation_name(spark, sf):
    k = C("p_partkey") % 4
    zh = F.when(k.isin(1, 2), C("p_type")).otherwise(F.lit("  "))
    en = F.when(k.isin(0, 1), C("p_name")).otherwise(F.lit(""))
    tax = kinds.taxonomy_label(F.lit("pillar"))
    d = table(spark, sf, "part").select("p_partkey", names.annotation_name(zh, en, tax["zh"], tax["en"], C("p_size")).alias("n"))
    return d.select("p_partkey", "n.zh", "n.en")


def accents_sql(x):
    for base, letters in names.ACCENTED.items():
        x = f"regexp_replace({x}, '[{letters}]', '{base}' || chr(769), 'g')"
    return x


@query("slugify", f"SELECT doc_id, substring(regexp_replace(regexp_replace({accents_sql('text')}, '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM documents")
def slugify(spark, sf):
    return table(spark, sf, "documents").select("doc_id", names.slugify(C("text")).alias("slug"))


@query("export_name", r"""
SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(CASE WHEN page_id % 10 = 0 THEN ' .- ' ELSE url END, '[/\\:*?"<>|]+', '-', 'g'), '\s+', '', 'g'), '^[.-]+|[.-]+$', '', 'g'), ''), 'report') AS stem FROM pages""")
def export_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", names.export_name(F.when(C("page_id") % 10 == 0, F.lit(" .- ")).otherwise(C("url"))).alias("stem"))


@query("is_wr_bubble", f"SELECT obj_id, upper(replace(CASE WHEN obj_id % 5 = 0 THEN 'Sh2-308' WHEN obj_id % 5 = 1 THEN 'ngc 6888' ELSE main_id END, ' ', '')) IN {in_sql(V.WIND_BUBBLES)} AS bubble, otype IN ('WR*', 'WR?') AS exciting FROM v_cat")
def is_wr_bubble(spark, sf):
    n = F.when(C("obj_id") % 5 == 0, F.array(F.lit("x"), F.lit("Sh2-308"))).when(C("obj_id") % 5 == 1, F.array(F.lit("ngc 6888"))).otherwise(C("names"))
    return catalog(spark, sf).select("obj_id", names.is_wind_bubble(n).alias("bubble"), names.is_exciting_star(C("otype")).alias("exciting"))


@query("paragraphs", r"""
SELECT conv_id, n AS turn, i AS para, trim(p, e' \t\n\r') AS text FROM (
 SELECT conv_id, turn AS n, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
  SELECT conv_id, turn, list_filter(string_split_regex(replace(text, e'\n', e'\n \n'), '\n\s*\n+'), lambda x: trim(x, e' \t\n\r') <> '') AS ps FROM conversations))""")
def paragraphs(spark, sf):
    body = F.replace(C("text"), F.lit("\n"), F.lit("\n \n"))
    d = table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(names.paragraphs(body, F.lit(None).cast("string"))).alias("i", "text"))
    return d.select("conv_id", "turn", (C("i") + 1).cast("long").alias("para"), "text")


@query("escape_markup", """SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS safe FROM pages""")
def escape_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", names.escape_markup(C("html")).alias("safe"))


@query("luminance", f"SELECT l_orderkey, l_partkey, l_linenumber, {s6('0.299 * l_quantity + 0.587 * l_tax + 0.114 * l_discount')} AS lum FROM lineitem")
def luminance(spark, sf):
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", kinds.luminance(C("l_quantity"), C("l_tax"), C("l_discount")).alias("lum")))


@query("prestige_sort", """
SELECT obj_id, row_number() OVER (PARTITION BY floor(dec_deg) ORDER BY CASE WHEN messier IS NOT NULL THEN 5 WHEN ngc IS NOT NULL THEN 4 WHEN sharpless IS NOT NULL THEN 3.5 WHEN source = 'SIMBAD' THEN 3 ELSE 1 END DESC,
 coalesce(size_major, 0) DESC, coalesce(mag, 99), src_rank, row_idx) AS place FROM v_cat""")
def prestige_sort(spark, sf):
    # Every row's place in the merge order of its degree of declination.
    key = kinds.prestige_sort(C("catalog_ids"), C("source"), C("famous"), C("size_major"), C("mag"), C("src_rank"), C("row_idx"))
    from pyspark.sql import Window
    ranked = catalog(spark, sf).withColumn("key", key).withColumn("zone", F.floor("dec_deg"))
    return rounded(ranked.select("obj_id", F.row_number().over(Window.partitionBy("zone").orderBy("key")).alias("place")))


@query("taxonomy_check", f"""
SELECT p_partkey, t AS feature_type FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'pillar' WHEN 1 THEN 'bubble_shell' ELSE p_type END AS t FROM part)
WHERE t NOT IN {in_sql(V.TAXONOMY)}""")
def taxonomy_check(spark, sf):
    from firmament.operators.contracts import taxonomy_check as check
    t = F.when(C("p_partkey") % 3 == 0, "pillar").when(C("p_partkey") % 3 == 1, "bubble_shell").otherwise(C("p_type"))
    return check(table(spark, sf, "part").select("p_partkey", t.alias("feature_type")))


@query("alias_union", """
SELECT obj_id, array_to_string(list_filter([messier, ngc, sharpless, CASE WHEN main_id NOT IN (coalesce(messier, ''), coalesce(ngc, ''), coalesce(sharpless, '')) THEN main_id END], lambda x: x IS NOT NULL), '|') AS aliases FROM v_cat""")
def alias_union(spark, sf):
    from firmament.operators.merge import alias_union as union
    return catalog(spark, sf).select("obj_id", F.array_join(union(F.map_values("catalog_ids"), C("names")), "|").alias("aliases"))


__all__ = ["values_sql"]
