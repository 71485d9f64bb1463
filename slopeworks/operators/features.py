"""Engineered listing features (I4-I11). Each block is added when its source columns are there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.functions import constants as K
from slopeworks.functions.numeric import flag, right_closed_bin
from slopeworks.functions.text import joined_key, to_number


def _num(name: str) -> Column:
    return to_number(F.col(name))


def age_features(as_of: int, year: str = "year") -> dict[str, Column]:
    age = F.lit(float(as_of)) - _num(year)
    return {"age": age, "age_squared": age * age, "is_classic": flag(age > 25)}


def mileage_features(as_of: int, year: str = "year", mileage: str = "mileage") -> dict[str, Column]:
    per_year = F.try_divide(_num(mileage), F.lit(float(as_of)) - _num(year) + 1)
    return {"mileage_per_year": per_year, "high_mileage": flag(per_year > 15000), "age_mileage_ratio": per_year}


def economy_features(city: str = "city_fuel_economy", highway: str = "highway_fuel_economy") -> dict[str, Column]:
    return {"combined_fuel_economy": (_num(city) + _num(highway)) / 2, "fuel_economy_diff": _num(highway) - _num(city)}


def size_features(length: str = "length", width: str = "width", height: str = "height") -> dict[str, Column]:
    return {"vehicle_volume": _num(length) * _num(width) * _num(height), "vehicle_footprint": _num(length) * _num(width)}


def legroom_features(back: str = "back_legroom", front: str = "front_legroom") -> dict[str, Column]:
    return {"total_legroom": _num(back) + _num(front), "legroom_ratio": F.try_divide(_num(back), _num(front) + 1)}


def power_feature(horsepower: str = "horsepower", volume: Column | None = None) -> dict[str, Column]:
    volume = F.col("vehicle_volume") if volume is None else volume
    return {"power_to_size_ratio": F.try_divide(_num(horsepower), volume + 1)}


def market_features(days: str = "daysonmarket") -> dict[str, Column]:
    return {"weeks_on_market": _num(days) / 7, "quick_sale": flag(_num(days) < 30)}


def category_features(columns: set[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if {"make_name", "model_name"} <= columns:
        out["make_model"] = joined_key(F.col("make_name"), F.col("model_name"))
    if "make_name" in columns:
        out["is_luxury"] = flag(F.lower("make_name").isin(K.LUXURY_BRANDS))
    if "horsepower" in columns:
        out["performance_category"] = right_closed_bin(_num("horsepower"), K.PERFORMANCE_EDGES, K.PERFORMANCE_LABELS)
    if "fuel_type" in columns:
        out["is_electric"] = flag(F.lower("fuel_type") == "electric")
        out["is_hybrid"] = flag(F.lower("fuel_type").contains("hybrid"))
    return out


def condition_score(*flags: str) -> Column:
    """3 minus the number of true flags, unknown counted as false."""
    score = F.lit(3)
    for name in flags:
        score = score - flag(F.col(name).cast("boolean"))
    return score


def price_tier(price: str = "price") -> Column:
    """Bins of the target: for reports only, never a model feature."""
    return right_closed_bin(_num(price), K.PRICE_TIER_EDGES, K.PRICE_TIER_LABELS)


def add_features(df: DataFrame, as_of: int) -> DataFrame:
    """All features the columns allow, in one projection that stays in generated code."""
    have = set(df.columns)
    new: dict[str, Column] = {}
    if "year" in have:
        new |= age_features(as_of)
    if {"year", "mileage"} <= have:
        new |= mileage_features(as_of)
    if {"city_fuel_economy", "highway_fuel_economy"} <= have:
        new |= economy_features()
    if {"length", "width", "height"} <= have:
        size = size_features()
        new |= size
        if "horsepower" in have:
            new |= power_feature(volume=size["vehicle_volume"])
    if {"back_legroom", "front_legroom"} <= have:
        new |= legroom_features()
    if "daysonmarket" in have:
        new |= market_features()
    new |= category_features(have)
    flags = [c for c in ("has_accidents", "frame_damaged", "fleet") if c in have]
    if flags:
        new["condition_score"] = condition_score(*flags)
    return df.withColumns(new)
