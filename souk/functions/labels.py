"""Label vocabularies of the analyses.

FIXED VALUES: the strings below are the exact labels the reference analyses
print; results are only comparable if they match character for character.
They are listed in the order each ladder tests them (first match wins).
"""

# ---- fixed values (must equal the reference's labels) -------------------------
VALID_ORDER_EXCLUDED = ("canceled", "unavailable")

RFM_BQ = ("Champions", "Loyal Customers", "At Risk", "Hibernating", "Potential Loyalist")
PARETO_TIERS = ("Top 20% (VIPs)", "Bottom 80% (Long Tail)")
SEASONALITY_TAGS = ("Black Friday Period", "Holiday Season", "New Year Peak", "Standard Period")
CATEGORY_SEGMENTS = ("High Vol / High Rev", "High Vol / Low Rev", "Low Vol / High Rev", "Standard")
REGIONAL_PROFILES = (
    "Major Economic Hub (High Vol / High Rev)",
    "Affluent Niche (Low Vol / High Rev)",
    "Mass Market (High Vol / Low Rev)",
    "Standard Market",
)
DELIVERY_BUFFER = (
    "Extremely Conservative (High Buffer)",
    "Relatively Aggressive (Lower Buffer)",
    "Standard (Aligned with National Avg)",
)
LOGISTICS_CLASSES = (
    "Logistics Gap (High Cost / Slow)",
    "Premium Service (High Cost / Fast)",
    "Budget / Inefficient (Low Cost / Slow)",
    "Optimized Logistics (Low Cost / Fast)",
)
SHIPMENT_TYPES = ("Local", "Long-Haul")
FREIGHT_IMPACT = (
    "High Abandonment Risk (>20%)",
    "Moderate Overhead",
    "Optimized / Low Shipping Impact",
)
MARKET_HEALTH = (
    "Monopoly / Highly Concentrated",
    "Dominant Leader",
    "Healthy / Fragmented Competition",
    "Moderate Competition",
)
SELLER_CHURN = ("Churned (Inactive in {next_year})", "Retained (Active in {next_year})")
PAYMENT_PROFILES = (
    "High Convenience / Installment Potential",
    "Cash-based / Single Payment",
    "Alternative Method",
)
BOLETO_PROFILES = (
    "High Boleto Usage (Low Credit Penetration)",
    "High Credit Usage (Digital/Banked Hub)",
    "Standard Regional Mix",
)
DELAY_TIERS = (
    "Early (Bonus Rating)",
    "On-Time (High Satisfaction)",
    "Late (Tolerable)",
    "Critical Delay (Satisfaction Cliff)",
    "Standard",
)
DELAY_SENTIMENT = (
    "Early (Bonus Satisfaction)",
    "On-Time (Expected)",
    "Late (Tolerable)",
    "Late (Critical Threshold Passed)",
    "Outlier",
)
QUALITY_MATRIX = (
    "Product/Catalog Issue (Fast but Hated)",
    "Logistics Bottleneck (Slow but Loved)",
    "Gold Standard (Fast & Loved)",
    "Systemic Failure (Slow & Hated)",
    "Standard Performance",
)
CATEGORY_ARCHETYPES = (
    "Paradox: Fast but Poorly Rated",
    "Gold Standard: Fast & Loved",
    "Operational Crisis: Slow & Hated",
    "Standard Performance",
)
COMMENT_TYPES = ("Vocal (Written Comment)", "Silent (Rating Only)")
COMMENT_TYPES_ALT = ("Written Feedback", "Rating-Only")
UNKNOWN_CATEGORY = "unknown_category"
VOLUME_BUCKETS = (
    "1-10 Reviews (Low)",
    "11-50 Reviews (Medium)",
    "51-100 Reviews (High)",
    "100+ Reviews (Very High)",
)
RESPONSE_SPEED = (
    "No Response Recorded",
    "1. Fast (Under 24 Hours)",
    "2. Medium (1 - 3 Days)",
    "3. Slow (3 - 7 Days)",
    "4. Very Slow (Over 1 Week)",
)
GROWTH_TAGS = (
    "Hyper-Growth (>20%)",
    "Positive Growth",
    "Stagnation / Contraction",
    "Baseline (No Prior Month)",
)
SEASONAL_CLASSES = (
    "Peak Month (Strong Seasonality)",
    "Standard Performance",
    "Low Season / Slack Period",
    "Baseline",
)
HOUR_WINDOWS = ("Lunchtime Spike Window", "Evening Spike Window", "Standard Time")
INTRADAY_SEPARATOR = "--- INTRA-DAY ANALYSIS ---"
RFM_MART = ("Champions", "Loyal Customers", "Potential Loyalist", "At Risk", "Hibernating", "Others")

# ---- end of fixed values -----------------------------------------------------
