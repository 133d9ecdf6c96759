"""Table schemas and the fixed values the results depend on.

Everything under "FIXED VALUES" must equal the application we reproduce
(category seed rows, keyword rules, recurring-payment words, bucket edges);
they are stated here once, in their natural order, and used everywhere else.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)
CONFIDENCE = T.DecimalType(4, 3)

# --------------------------------------------------------------------------
# Schemas
# --------------------------------------------------------------------------

RAW_FEED = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("amount", T.StringType()),
    T.StructField("category", T.StringType()),
])

CATEGORIES = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("color_hex", T.StringType()),
    T.StructField("is_essential", T.IntegerType()),
])

TRANSACTIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("date", T.DateType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("category_id", T.LongType()),
    T.StructField("category_raw", T.StringType()),
    T.StructField("predicted_cat", T.StringType()),
    T.StructField("confidence", CONFIDENCE),
    T.StructField("is_recurring", T.IntegerType()),
    T.StructField("notes", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

BUDGETS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("category_id", T.LongType(), False),
    T.StructField("month", T.StringType(), False),
    T.StructField("budget_amt", MONEY, False),
])

DEFAULT_COLOR = "#6B7280"

# --------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced application)
# --------------------------------------------------------------------------

# Seed categories: (name, description, color_hex, is_essential), in seed order.
SEED_CATEGORIES = [
    ("rent", "Housing / rent payments", "#EF4444", 1),
    ("groceries", "Supermarkets and food stores", "#22C55E", 1),
    ("food_drink", "Restaurants, cafes, takeaway", "#F97316", 0),
    ("transport", "Uber, Lyft, gas, transit", "#3B82F6", 1),
    ("subscriptions", "Streaming, SaaS, memberships", "#8B5CF6", 0),
    ("health", "Pharmacy, gym, medical", "#EC4899", 1),
    ("shopping", "Retail, Amazon, general merchandise", "#F59E0B", 0),
    ("utilities", "Electric, internet, phone", "#06B6D4", 1),
    ("travel", "Flights, hotels", "#14B8A6", 0),
    ("home", "Home improvement, furniture", "#84CC16", 0),
    ("transfers", "Peer transfers, Venmo, Zelle", "#94A3B8", 0),
    ("cash", "ATM withdrawals", "#6B7280", 0),
    ("uncategorized", "Needs manual review", "#D1D5DB", 0),
]
UNCATEGORIZED = "uncategorized"

# Words that mark a description as a recurring payment (unanchored).
RECURRING_PATTERN = "SUBSCRIPTION|PREMIUM|MEMBERSHIP|BILL|PAYMENT|WIRELESS|INTERNET"

# Keyword rules, first match wins; patterns are unanchored regexes applied to
# the upper-cased description.
KEYWORD_RULES = [
    ("rent", "RENT|LEASE|MORTGAGE|HOUSING|CONDO"),
    ("groceries", "GROCER|SUPERMARKET|CONTINENTE|PINGO DOCE|AUCHAN|LIDL|ALDI"),
    ("food_drink", "COFFEE|CAFE|MCDONALDS|UBER EATS|GLOVO|RESTAURANT|BURGER"),
    ("transport", "UBER|BOLT|GALP|REPSOL|BP|PRIO|METRO|TRAIN|PARKING"),
    ("subscriptions", "NETFLIX|SPOTIFY|DISNEY|APPLE|AMAZON PRIME|HBO|SUBSCR"),
    ("home", "IKEA|LEROY MERLIN|CONFORAMA|CASA|HOME"),
    ("shopping", "AMAZON|WORTEN|FNAC|ZARA|SHOPPING|PURCHASE"),
    ("health", "PHARMACY|HEALTH|CLINIC|GYM|FITNESS|HOSPITAL"),
    ("utilities", "EDP|ENDESA|WATER|ELECTRICITY|MEO|NOS|VODAFONE|BILL"),
    ("travel", "AIRLINE|TAP|HOTEL|AIRBNB|TRAVEL|TRIP|FLIGHT"),
]

# Amount buckets: right-closed bins (0,10] (10,25] (25,50] (50,100] (100,250] (250,inf),
# lowest bin closed on the left as well.
BUCKET_EDGES = [10, 25, 50, 100, 250]
BUCKET_LABELS = ["tiny", "small", "medium", "large", "xlarge", "huge"]

# Default merchant search terms of the coffee-shop drill-down.
DEFAULT_MERCHANT_TERMS = ["CAFE", "DELTA", "STARBUCKS", "COFFEE"]

# Vocabulary size of the bag-of-words features.
VOCAB_SIZE = 80
# Large-amount threshold and the "round" modulus of the amount features.
LARGE_AMOUNT = 200
ROUND_MODULUS = 10

# Budget status labels.
STATUS_UNDER = "✅ Under"
STATUS_OVER = "⚠️ Over"

# Two-sided 95 % normal quantile used by the forecast intervals.
Z95 = 1.959963984540054
