"""Fixed values of the listing data model: names, word lists, patterns and bin edges that results depend on."""

# Brands that count as luxury.
LUXURY_BRANDS = [
    "audi", "bmw", "cadillac", "jaguar", "land rover",
    "lexus", "lincoln", "mercedes-benz", "porsche", "tesla",
]

# Right-closed bin edges and their labels, in order.
PERFORMANCE_EDGES = [0.0, 150.0, 250.0, 350.0, float("inf")]
PERFORMANCE_LABELS = ["economy", "standard", "performance", "high_performance"]
PRICE_TIER_EDGES = [0.0, 15000.0, 30000.0, 50000.0, float("inf")]
PRICE_TIER_LABELS = ["budget", "mid_range", "premium", "luxury"]

# Size columns that carry a unit after the number, and the patterns that read them.
UNIT_COLUMNS = [
    "back_legroom", "front_legroom", "fuel_tank_volume", "height",
    "length", "maximum_seating", "wheelbase", "width",
]
FIRST_NUMBER = r"(\d+\.?\d*)"
HORSEPOWER = r"(\d+)\s*hp"
LEADING_INTEGER = r"(\d+)"
AT_RPM = r"@\s*(\d+)"

# Columns read by the preparation job.
LISTING_COLUMNS = [
    "price", "year", "make_name", "model_name", "body_type", "fuel_type", "engine_type",
    "transmission", "wheel_system", "mileage", "horsepower", "engine_displacement",
    "city_fuel_economy", "highway_fuel_economy", "maximum_seating", "daysonmarket",
    "length", "width", "height", "wheelbase", "back_legroom", "front_legroom",
    "fuel_tank_volume", "is_new", "has_accidents", "frame_damaged", "fleet", "owner_count",
    "seller_rating", "exterior_color", "interior_color", "torque", "power", "listing_color",
]

# Columns whose category means of the target become features.
TARGET_ENCODED = ["make_name", "model_name", "make_model", "body_type"]
TARGET_SMOOTHING = 30
TARGET_MIN_DISTINCT = 10

# Algorithm family to category.
FAMILY_CATEGORY = {
    "gradient_descent": "First-Order Methods",
    "stochastic_gd": "Stochastic Methods",
    "newton_method": "Second-Order Methods",
    "quasi_newton": "Quasi-Newton Methods",
    "proximal_gd": "Proximal Methods",
    "advanced_methods": "Advanced Methods",
}

# Step constants of the four subgradient rules.
SUBGRADIENT_STEPS = {"constant_step": 0.02, "constant_length": 0.04, "square_summable": 1.0, "diminishing": 1.0}

# Fixed value: smoothing inside sqrt(w^2 + eps) of the smoothed L1 penalty.
LASSO_EPS = 1e-8
