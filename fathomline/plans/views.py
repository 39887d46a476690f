"""The catalogue's named views as DataFrames over its base tables.

Lists hold distinct non-null values in order; an entity without links has an empty list. Each
linked branch is aggregated by itself before it joins, so branches never multiply one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.operators.keys import latest
from fathomline.operators.nested import sorted_set
from fathomline.sources.catalog import Catalog


def listed(links: DataFrame, key: str, *lists: tuple[str, str]) -> DataFrame:
    """(key, lists): each (column, name) as a sorted set per key."""
    return links.groupBy(key).agg(*(sorted_set(c).alias(n) for c, n in lists))


def with_lists(df: DataFrame, key: str, branches: list[tuple[DataFrame, tuple[str, ...]]]) -> DataFrame:
    """``df`` with the list columns of each branch, empty where it has no row."""
    for branch, names in branches:
        df = df.join(branch, key, "left").withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in names})
    return df


class Views:
    """Builders by view name; nothing runs until a result is asked for."""

    NAMES = (
        "funding_links", "v_facility_map", "v_facility_enriched", "v_region_enriched", "v_facility_funding_by_year",
        "v_funder_funding_by_year", "v_funding_ledger", "v_facility_funding_by_year_real", "v_facility_key_personnel",
        "v_person_enriched", "v_person_areas_enriched", "v_person_validation_latest", "v_person_validation_summary",
        "v_coauthor_edges_enriched",
    )

    def __init__(self, catalog: Catalog, anchor_year: int = 2024, today: Column | None = None):
        self.catalog, self.anchor_year = catalog, anchor_year
        self.today = today if today is not None else F.current_date()

    def _t(self, name: str) -> DataFrame:
        df = self.catalog.get(name)
        if df is None:
            raise KeyError(name)
        return df

    def register(self) -> list[str]:
        """Temporary views for spark.sql; a view whose tables are missing is left out."""
        made = []
        for name in self.NAMES:
            try:
                getattr(self, name)().createOrReplaceTempView(name)
                made.append(name)
            except KeyError:
                continue
        return made

    def funding_links(self) -> DataFrame:
        return self._t("funding_events").select("funder_id", "facility_id", "amount_usd", "fiscal_year", "award_id", "relation", "source_url")

    def v_facility_map(self) -> DataFrame:
        f = self._t("facilities").where("hq_lat IS NOT NULL AND hq_lng IS NOT NULL")
        return f.selectExpr("facility_id AS id", "canonical_name AS name", "acronym", "facility_type AS type", "country", "region", "hq_lat AS lat", "hq_lng AS lng", "url", "parent_org")

    def v_facility_enriched(self) -> DataFrame:
        """Facilities with their lists. What older tables don't have is null, and lists of layers that aren't there are empty."""
        held = self._t("facilities")
        later = {"parent_org": "string", "established": "int", "record_length_years": "int", "long_term_threshold_met": "boolean", "data_portal_url": "string"}
        base = held.select(
            "facility_id", "canonical_name", "acronym", "facility_type", "country", "hq_lat", "hq_lng", "url",
            *((F.col(c) if c in held.columns else F.lit(None).cast(t)).alias(c) for c, t in later.items()))
        areas = self._t("area_links").join(self._t("research_areas"), "area_id")
        networks = self._t("network_membership").join(self._t("networks"), "network_id")
        funders = self._t("funding_events").select("facility_id", "funder_id").distinct().join(self._t("funders"), "funder_id")
        regions = self._t("facility_regions").select("facility_id", "region_id").join(self._t("regions"), "region_id")
        return with_lists(base, "facility_id", [
            (listed(areas, "facility_id", ("label", "research_areas")), ("research_areas",)),
            (listed(networks, "facility_id", ("label", "networks")), ("networks",)),
            (listed(funders, "facility_id", ("name", "funders")), ("funders",)),
            (listed(regions, "facility_id", ("name", "regions")), ("regions",)),
            (self._layer("facility_spheres", "sphere_slug", "spheres", "spheres"), ("spheres",)),
            (self._layer("facility_ecosystems", "ecosystem_slug", "ecosystem_types", "ecosystem_types"), ("ecosystem_types",)),
        ])

    def _layer(self, links: str, slug: str, labels: str, name: str) -> DataFrame:
        """(facility_id, name): the labels of a layer's entries; no rows where one of its tables lacks."""
        a, b = self.catalog.get(links), self.catalog.get(labels)
        if a is None or b is None:
            return self._t("facilities").select("facility_id", F.array().cast("array<string>").alias(name)).limit(0)
        return listed(a.select("facility_id", F.col(slug).alias("slug")).join(b.select("slug", "label"), "slug"), "facility_id", ("label", name))

    def v_region_enriched(self) -> DataFrame:
        labels = self._t("networks").select("network_id", F.col("label").alias("network_label"))
        base = self._t("regions").join(labels, "network_id", "left").select(
            "region_id", "name", "acronym", "kind", "network_id", "network_label", "url", "manager", "designated", "state", "description")
        areas = self._t("region_area_links").join(self._t("research_areas"), "area_id")
        held = self._t("facility_regions").select("region_id", "facility_id").join(self._t("facilities").select("facility_id", "canonical_name"), "facility_id", "left")
        inside = held.groupBy("region_id").agg(sorted_set("canonical_name").alias("facilities"), F.countDistinct("facility_id").alias("facility_count"))
        out = with_lists(base, "region_id", [(listed(areas, "region_id", ("label", "research_areas")), ("research_areas",)), (inside, ("facilities",))])
        return out.withColumn("facility_count", F.coalesce("facility_count", F.lit(0)))

    def _yearly(self) -> DataFrame:
        return self._t("funding_events").where("fiscal_year IS NOT NULL AND amount_usd IS NOT NULL")

    def v_facility_funding_by_year(self) -> DataFrame:
        funders = self._t("funders").select("funder_id", "name")
        sums = self._yearly().join(funders, "funder_id").groupBy("facility_id", "fiscal_year").agg(
            F.sum("amount_usd").alias("total_usd_nominal"), F.count("*").alias("n_awards"), sorted_set("name").alias("funders"))
        names = self._t("facilities").selectExpr("facility_id", "canonical_name AS facility", "acronym")
        return sums.join(names, "facility_id").select("facility_id", "facility", "acronym", "fiscal_year", "total_usd_nominal", "n_awards", "funders")

    def v_funder_funding_by_year(self) -> DataFrame:
        sums = self._yearly().groupBy("funder_id", "fiscal_year").agg(
            F.sum("amount_usd").alias("total_usd_nominal"), F.count("*").alias("n_awards"), F.countDistinct("facility_id").alias("n_facilities"))
        return sums.join(self._t("funders").selectExpr("funder_id", "name AS funder", "type AS funder_type"), "funder_id").select(
            "funder_id", "funder", "funder_type", "fiscal_year", "total_usd_nominal", "n_awards", "n_facilities")

    def v_funding_ledger(self) -> DataFrame:
        funders = self._t("funders").selectExpr("funder_id", "name AS funder", "type AS funder_type")
        facilities = self._t("facilities").selectExpr("facility_id", "canonical_name AS facility", "acronym AS facility_acronym", "facility_type AS facility_kind", "country")
        return self._t("funding_events").join(funders, "funder_id").join(facilities, "facility_id").select(
            "event_id", "fiscal_year", "period_start", "period_end", "funder", "funder_type", "facility", "facility_acronym", "facility_kind",
            "country", F.col("amount_usd").alias("amount_usd_nominal"), "amount_currency", "award_id", "award_title", "program", "relation",
            "source", "source_url", "retrieved_at", "confidence", "notes")

    def v_facility_funding_by_year_real(self) -> DataFrame:
        index = self._t("cpi_index_us").select(F.col("year").alias("fiscal_year"), "cpi_u")
        anchor = index.where(F.col("fiscal_year") == self.anchor_year).agg(F.max("cpi_u").alias("anchor"))
        real = F.col("total_usd_nominal") * F.try_divide(F.col("anchor"), F.col("cpi_u"))
        return self.v_facility_funding_by_year().join(F.broadcast(index), "fiscal_year", "left").crossJoin(F.broadcast(anchor)).select(
            "facility_id", "facility", "acronym", "fiscal_year", "total_usd_nominal", "n_awards", "funders", real.alias(f"total_usd_real_{self.anchor_year}"))

    def v_facility_key_personnel(self) -> DataFrame:
        now = self._t("facility_personnel").where(F.col("is_key_personnel") & (F.col("end_date").isNull() | (F.col("end_date") > self.today)))
        people = self._t("people").select("person_id", "name", "orcid", "openalex_id", "email", "homepage_url")
        facilities = self._t("facilities").selectExpr("facility_id", "canonical_name AS facility", "acronym AS facility_acronym")
        return now.select("facility_id", "person_id", "role", "title", "start_date", "source_url").join(people, "person_id").join(facilities, "facility_id").select(
            "facility_id", "facility", "facility_acronym", "person_id", "name", "role", "title", "orcid", "openalex_id", "email", "homepage_url", "start_date", "source_url")

    def v_person_enriched(self) -> DataFrame:
        base = self._t("people").select("person_id", "name", "name_family", "orcid", "openalex_id", "email", "homepage_url", "research_interests", "status")
        posts = self._t("facility_personnel").select("person_id", "facility_id", "role").join(self._t("facilities").select("facility_id", "canonical_name"), "facility_id", "left")
        areas = self._t("person_areas").select("person_id", "area_id").join(self._t("research_areas"), "area_id")
        works = self._t("authorship").select("person_id", "publication_id").join(self._t("publications").select("publication_id", "pub_year"), "publication_id", "left")
        counted = works.groupBy("person_id").agg(F.countDistinct("publication_id").alias("n_publications"), F.max("pub_year").alias("latest_pub_year"))
        out = with_lists(base, "person_id", [
            (listed(posts, "person_id", ("canonical_name", "facilities"), ("role", "roles")), ("facilities", "roles")),
            (listed(areas, "person_id", ("label", "research_areas")), ("research_areas",)),
        ])
        return out.join(counted, "person_id", "left").withColumn("n_publications", F.coalesce("n_publications", F.lit(0)))

    def v_person_areas_enriched(self) -> DataFrame:
        people = self._t("people").selectExpr("person_id", "name AS person")
        areas = self._t("research_areas").selectExpr("area_id", "label AS area")
        posts = self._t("facility_personnel").select("person_id", "facility_id").join(self._t("facilities").select("facility_id", "canonical_name"), "facility_id")
        base = self._t("person_areas").join(people, "person_id").join(areas, "area_id").select("person_id", "person", "area_id", "area", "weight", "evidence_count", "source")
        return with_lists(base, "person_id", [(listed(posts, "person_id", ("canonical_name", "facilities")), ("facilities",))])

    def v_person_validation_latest(self) -> DataFrame:
        return latest(self._t("person_validation"), ["canonical_id", "check_id"], F.desc_nulls_last("retrieved_at"), F.desc_nulls_last("run_id"))

    def v_person_validation_summary(self) -> DataFrame:
        n = lambda v: F.count_if(F.col("verdict") == v)
        told = self.v_person_validation_latest().groupBy("canonical_id").agg(
            n("pass").alias("n_pass"), n("fail").alias("n_fail"), n("not_applicable").alias("n_not_applicable"), n("unresolved").alias("n_unresolved"))
        zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_pass", "n_fail", "n_not_applicable", "n_unresolved")}
        return self._t("person_registry").join(told, "canonical_id", "left").withColumns(zero).select(
            "canonical_id", "display_name", "tier", *zero, F.try_divide("n_pass", F.col("n_pass") + F.col("n_fail")).alias("pass_rate"),
            (F.col("orcid").isNotNull() | F.col("openalex_id").isNotNull() | F.col("affiliation_ror").isNotNull()).alias("has_persistent_id"),
            (F.col("source_url").isNotNull() & (F.col("source_url") != "")).alias("has_source_url"),
            F.col("confidence").isin("high", "medium", "low").alias("has_valid_confidence"),
        )

    def v_coauthor_edges_enriched(self) -> DataFrame:
        out = self._t("coauthor_edges")
        for end in ("a", "b"):
            names = self._t("person_registry").selectExpr(f"canonical_id AS canonical_id_{end}", f"display_name AS name_{end}", f"affiliation AS affiliation_{end}")
            out = out.join(names, f"canonical_id_{end}")
        return out
