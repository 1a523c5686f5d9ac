"""Canonical tables and fixed dimension values."""

from __future__ import annotations

from pyspark.sql import types as T

from .functions.geo import Box

S, D = T.StringType(), T.DoubleType()


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


PLACES = _schema(
    ("restaurant_name", S), ("address", S), ("phone_number", S), ("website_url", S),
    ("happy_hour_times", S), ("regular_hours", S), ("rating", S), ("review_count", S),
    ("price_level", S), ("source", S), ("freshness_date", S), ("latitude", S), ("longitude", S),
    ("place_id", S), ("google_maps_url", S), ("generative_summary", S),
    ("cheapest_drink", S), ("cheapest_drink_price", D), ("cheapest_food", S),
    ("cheapest_food_price", D), ("menu_summary", S), ("menu_url", S),
)
# A column that a file does not have reads as this; a blank cell reads as NULL.
PLACES_NULL_WHEN_ABSENT = {
    "latitude", "longitude", "cheapest_drink", "cheapest_drink_price", "cheapest_food",
    "cheapest_food_price", "menu_summary", "menu_url",
}

MENU = _schema(
    ("restaurant_name", S), ("place_id", S), ("cheapest_drink", S), ("cheapest_drink_price", D),
    ("cheapest_food", S), ("cheapest_food_price", D), ("menu_summary", S), ("menu_url", S),
)
MENU_NULL_WHEN_ABSENT = {"cheapest_drink_price", "cheapest_food_price"}

OVERRIDES = _schema(
    ("place_id", S), ("restaurant_name", S), ("happy_hour_times", S), ("source", S), ("freshness_date", S),
)

# Columns a refresh never blanks: they were extracted, not fetched.
EXTRACTED_COLUMNS = (
    "happy_hour_times", "menu_summary", "cheapest_drink", "cheapest_drink_price",
    "cheapest_food", "cheapest_food_price", "menu_url",
)

_HOURS = T.StructType([T.StructField("weekdayDescriptions", T.ArrayType(S))])
PLACE_DOCUMENT = _schema(
    ("id", S),
    ("displayName", _schema(("text", S), ("languageCode", S))),
    ("formattedAddress", S),
    ("types", T.ArrayType(S)),
    ("nationalPhoneNumber", S),
    ("websiteUri", S),
    ("regularOpeningHours", _HOURS),
    ("currentSecondaryOpeningHours", T.ArrayType(
        _schema(("secondaryHoursType", S), ("weekdayDescriptions", T.ArrayType(S))))),
    # Numbers are read as written, so that 4 stays 4 and does not become 4.0.
    ("rating", S),
    ("userRatingCount", S),
    ("priceLevel", S),
    ("location", _schema(("latitude", S), ("longitude", S))),
    ("googleMapsUri", S),
)

# Named areas of the directory, in match order.
NEIGHBORHOODS = [
    Box(32.745, -117.135, 32.755, -117.115, "north_park", "North Park"),
    Box(32.720, -117.135, 32.745, -117.115, "south_park", "South Park"),
    Box(32.755, -117.135, 32.775, -117.115, "normal_heights", "Normal Heights"),
    Box(32.735, -117.170, 32.760, -117.145, "hillcrest", "Hillcrest"),
    Box(32.715, -117.170, 32.730, -117.155, "little_italy", "Little Italy"),
    Box(32.705, -117.165, 32.720, -117.155, "gaslamp", "Gaslamp"),
    Box(32.785, -117.260, 32.805, -117.230, "pacific_beach", "Pacific Beach"),
    Box(32.735, -117.260, 32.755, -117.235, "ocean_beach", "Ocean Beach"),
    Box(32.755, -117.200, 32.775, -117.170, "mission_valley", "Mission Valley"),
    Box(32.790, -117.210, 32.815, -117.180, "clairemont", "Clairemont"),
    Box(32.820, -117.160, 32.835, -117.140, "convoy", "Convoy"),
    Box(32.830, -117.280, 32.860, -117.240, "la_jolla", "La Jolla"),
    Box(32.860, -117.240, 32.880, -117.220, "utc", "UTC"),
]

# Areas used for fetching; one north edge differs from the list above.
SEARCH_AREAS = {b.id: b for b in NEIGHBORHOODS} | {
    "north_park": Box(32.745, -117.135, 32.770, -117.115, "north_park", "North Park"),
}
DEFAULT_AREA = Box(32.64, -117.28, 32.88, -117.08, "default", "Default")

# Smallest cell side in miles, overlap past the midline, results cap.
MIN_CELL_MILES = 0.75
CELL_OVERLAP = 0.075
RESULTS_CAP = 60
# Half sides of the box around a single point, in degrees.
POINT_HALF_LAT = 0.012
POINT_HALF_LNG = 0.015

# Search keywords, first tier and gap fillers.
FIRST_KEYWORDS = ["restaurant", "bar", "happy hour"]
MORE_KEYWORDS = [
    "pub", "brewery", "gastropub", "cocktail bar", "wine bar", "sports bar", "lounge", "taproom",
    "distillery", "seafood restaurant", "steakhouse", "sushi restaurant", "mexican restaurant",
    "italian restaurant", "american restaurant", "thai restaurant", "burgers", "bbq", "pizza",
]

# Category words that keep a place, and those that alone drop it.
KEEP_CATEGORIES = [
    "bar", "restaurant", "night_club", "liquor_store", "brewery", "winery", "distillery",
    "cocktail_bar", "wine_bar", "sports_bar", "gastropub", "pub", "tavern", "american_restaurant",
    "mexican_restaurant", "italian_restaurant", "japanese_restaurant", "chinese_restaurant",
    "thai_restaurant", "vietnamese_restaurant", "korean_restaurant", "seafood_restaurant",
    "steak_house", "sushi_restaurant", "pizza_restaurant", "mediterranean_restaurant",
    "indian_restaurant", "barbecue_restaurant", "hamburger_restaurant", "ramen_restaurant",
]
DROP_CATEGORIES = [
    "cafe", "coffee_shop", "bakery", "ice_cream_shop", "dessert_shop", "dessert_restaurant",
    "confectionery", "donut_shop", "candy_store", "juice_bar", "smoothie_shop",
    "bubble_tea_store", "fast_food_restaurant", "breakfast_restaurant", "brunch_restaurant",
    "gas_station", "convenience_store", "supermarket", "grocery_store", "pharmacy", "bank", "atm",
    "car_repair", "parking", "park", "school", "hospital", "library", "place_of_worship",
    "local_government_office", "museum", "food", "point_of_interest", "establishment",
]
