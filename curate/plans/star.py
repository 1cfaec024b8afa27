"""Star schema of premises, licences, accounts and area measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import conditional_concat, sha1_key
from ..operators import bridge, dim_distinct, dim_md5, dim_one_per_key, dim_sha1, keep_one, left_lookup, pivot_wide, project

# The columns of the star schema.
ADDRESS = ("address_line_1", "address_line_2", "city", "postcode")
POSTCODE_COLUMNS = (
    "postcode", "postcode_area", "postcode_district", "in_use", "latitude", "longitude", "constituency",
    "average_income", "population", "households", "distance_to_station", "index_of_multiple_deprivation",
)
CLASS_COLUMNS = (
    "full_time_students",
    "intermediate_occupations",
    "intermediate_occupations_small_employers_and_own_account_workers",
    "managerial__administrative_and_professional_occupations_higher_managerial__administrative_and_professional_occupations",
    "managerial__administrative_and_professional_occupations_lower_managerial__administrative_and_professional_occupations",
    "never_worked___long_term_unemployed",
    "routine_and_manual_occupations_lower_supervisory_and_technical_occupations",
    "routine_and_manual_occupations_routine_occupations",
    "routine_and_manual_occupations_semi_routine_occupations",
)
DEPRIVATION_COLUMNS = (
    "imd_rank_2019", "income", "employment", "education_skills_and_training", "health_deprivation_and_disability",
    "crime", "barriers_to_housing_and_services", "living_environment",
)


def full_address(*parts: Column) -> Column:
    """The address on one line, without its absent parts."""
    return F.concat_ws(", ", *parts)


def premises_key() -> Column:
    return sha1_key(*[F.col(c) for c in ADDRESS])


def dim_accounts(register: DataFrame) -> DataFrame:
    """Distinct accounts."""
    return dim_distinct(register, {"account_number": "accountid", "account_name": "account_name"})


def dim_account_premises(register: DataFrame) -> DataFrame:
    """Distinct accounts per premises."""
    return register.select(
        premises_key().alias("premisesid"), F.col("account_number").alias("accountid"), "account_name"
    ).distinct()


def dim_premises(register: DataFrame, one_per_key: bool = True) -> DataFrame:
    """Distinct addresses under a hashed key, with the address on one line."""
    dim = dim_sha1(register, "premisesid", ADDRESS, ["local_authority"], distinct=not one_per_key)
    dim = dim_one_per_key(dim, "premisesid") if one_per_key else dim
    return dim.withColumn("full_address", full_address(*[F.col(c) for c in ADDRESS]))


def place_premises(premises: DataFrame, postcodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Premises with the postcode's key, area, district and constituency, and the
    constituency's key. Premises whose postcode or constituency is unknown stay.

    ``postcodes`` is a :func:`dim_postcodes` and ``classes`` a :func:`dim_classes`.
    """
    areas = postcodes.select("postcode", "postcodeid", "postcode_area", "postcode_district", "constituency")
    seats = classes.select("constituencyid", F.col("constituencyname").alias("constituency"))
    placed = left_lookup(premises, dim_one_per_key(areas, "postcode"), F.col("postcode"), "postcode")
    return left_lookup(placed, dim_one_per_key(seats, "constituency"), F.col("constituency"), "constituency")


def dim_business_status(results: DataFrame) -> DataFrame:
    """The latest search result of each premises."""
    latest = keep_one(results, ["premisesid"], [F.desc("api_call_date"), "g_place_id"])
    return project(
        latest,
        {
            "premisesid": "premisesid",
            "full_address": "full_address",
            "g_place_id": "g_place_id",
            "g_formatted_address_1": "g_formatted_address",
            "g_business_status_1": "g_business_status",
            "api_call_date": "api_call_date",
        },
    )


def dim_activity(register: DataFrame) -> DataFrame:
    """Distinct licences: one row per premises and activity."""
    rows = register.select(premises_key().alias("premisesid"), F.col("premises_activity").alias("activity"))
    return bridge(rows, "premises_licenceid", ["premisesid", "activity"])


def dim_postcodes(postcodes: DataFrame) -> DataFrame:
    """Postcodes under a hashed key."""
    return dim_md5(postcodes, "postcodeid", "postcode", POSTCODE_COLUMNS)


def dim_classes(
    long: DataFrame,
    attributes: Sequence[str] | None = None,
    columns: Mapping[str, str] | None = None,
    on_duplicate: str = "error",
) -> DataFrame:
    """Class counts per constituency from rows ``(onsconstid, constituencyname, groups, variables, con_num)``."""
    named = long.withColumn("group_variable", conditional_concat(F.col("groups"), F.col("variables")))
    wide = pivot_wide(
        named, ["onsconstid", "constituencyname"], "group_variable", "con_num", attributes, on_duplicate
    )
    kept = columns or {name: name for name in CLASS_COLUMNS}
    return project(wide, {"onsconstid": "constituencyid", "constituencyname": "constituencyname", **kept})


def dim_deprivation(clean: DataFrame) -> DataFrame:
    """Deprivation measures per constituency."""
    return project(
        clean,
        {"onsconstid": "constituencyid", "constituencyname": "constituencyname"}
        | {name: name for name in DEPRIVATION_COLUMNS},
    )


def star_join(fact: DataFrame, dims: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """All rows of ``fact``, with each of ``dims = [(dimension, key), ...]`` joined on its key.

    The key must be unique in its dimension; see :func:`left_lookup`.
    """
    for dim, key in dims:
        clash = (set(dim.columns) - {key}) & set(fact.columns)
        if clash:
            raise ValueError(f"columns on both sides of the join on {key}: {', '.join(sorted(clash))}")
        fact = left_lookup(fact, dim, F.col(f"`{key}`"), key)
    return fact
