"""Words, limits and names that decide results and so must keep exactly these values."""

# Listing site and record defaults.
BASE_URL = "https://batdongsan.com.vn"
LIST_PATH = "/nha-dat-ban"
VERIFIED_QUERY = ("vrs", "1")
RECORD_SOURCE = "batdongsan"
DEFAULT_SOURCE = "batdongsan_verified"

# URL slug -> property type, tried in this order.
PROPERTY_TYPE_SLUGS = [
    ("/ban-nha-rieng", "house"),
    ("/ban-can-ho-chung-cu", "apartment"),
    ("/ban-dat", "land"),
    ("/ban-nha-biet-thu-lien-ke", "villa_townhouse"),
    ("/ban-shophouse-nha-pho-thuong-mai", "shophouse"),
    ("/ban-kho-nha-xuong", "warehouse"),
]
PROPERTY_TYPES = ["house", "apartment", "land", "villa_townhouse", "shophouse", "warehouse"]

# Detail page, fixed values: the blocks and labels a field is read from, the first filled one first.
DETAIL_LABELS = {
    "listing_id": [("short", "Mã tin")],
    "listing_type": [("short", "Loại tin")],
    "posted_date_text": [("short", "Ngày đăng")],
    "price_text": [("short", "Khoảng giá"), ("spec", "Khoảng giá")],
    "area_text": [("short", "Diện tích"), ("spec", "Diện tích")],
    "bedroom_text": [("short", "Phòng ngủ"), ("spec", "Số phòng ngủ")],
    "bathroom_text": [("spec", "Số phòng tắm, vệ sinh")],
    "floor_text": [("spec", "Số tầng")],
    "front_width_text": [("spec", "Mặt tiền")],
    "road_width_text": [("spec", "Đường vào")],
    "legal_text": [("spec", "Pháp lý")],
    "direction_text": [("spec", "Hướng nhà")],
    "furniture_text": [("spec", "Nội thất")],
}
DESCRIPTION_PARTS = 18

# Price units in VND, and how a lower-case text names them.
BILLION = 1e9
MILLION = 1e6
BILLION_NAMES = "t(?:ỷ|y)"
MILLION_NAMES = "tri(?:ệu|eu)"

# Validation limits.
MAX_PRICE_VND = 500e9
MAX_AREA_M2 = 10000.0
PER_M2_ABS_TOLERANCE = 1.0
PER_M2_REL_TOLERANCE = 0.05
MIN_CANDIDATE_COVERAGE = 5

# Model inputs and settings.
NUMERIC_FEATURES = [
    "area_m2",
    "bedroom_count",
    "bathroom_count",
    "floor_count",
    "front_width_m",
    "road_width_m",
]
CATEGORICAL_FEATURES = [
    "property_type",
    "direction",
    "legal",
    "listing_type",
    "province_slug",
    "district_slug",
    "ward_slug",
    "project_hint",
]
TEXT_FEATURE = "text_features"
TARGET = "price_vnd"
MAX_TEXT_TERMS = 3000
RIDGE_ALPHA = 3.0
BOOST_DEPTH = 8
BOOST_RATE = 0.06
BOOST_ROUNDS = 250
BOOST_LEAF_ROWS = 20
BOOST_LEAVES = 31
BOOST_JUDGE_ROWS = 10_000
SEED = 42
TEST_SHARE = 0.2
MIN_TRAIN_ROWS = 200
MIN_SCHEDULED_TRAIN_ROWS = 500

# Model gate, fixed values: metric, limit to pass, limit to fail. Above the limits is good for r2 and sample_count.
MODEL_LIMITS = [
    ("r2", 0.75, 0.70),
    ("mae_vnd", 500e6, 800e6),
    ("rmse_vnd", 800e6, 1.2e9),
    ("mape_pct", 15.0, 20.0),
    ("sample_count", 5000.0, 3000.0),
]
MODEL_GAIN, MODEL_DROP = 0.01, 0.05

# Message topics and tables.
RAW_TOPIC = "real_estate_raw"
FEATURE_TOPIC = "real_estate_features"
CONSUMER_GROUP = "real_estate_training_pipeline"

# Metric names.
CONSUMED = "kafka_messages_consumed_total"
PROCESSED = "kafka_messages_processed_total"
FAILED = "kafka_messages_failed_total"
LAG = "kafka_consumer_lag"
WRITES_OK = "db_writes_success_total"
WRITES_FAILED = "db_writes_failed_total"
DURATION_SUM = "processing_duration_seconds_sum"
DURATION_COUNT = "processing_duration_seconds_count"
TRAIN_SUM = "model_train_duration_seconds_sum"
TRAIN_COUNT = "model_train_duration_seconds_count"
MAE = "model_mae_vnd"
RMSE = "model_rmse_vnd"
R2 = "model_r2"
SAMPLES = "model_sample_count"
RUNS = "trainer_runs_total"
RUNS_FAILED = "trainer_runs_failed_total"
LAST_RUN = "trainer_last_run_timestamp_seconds"
LAST_SUCCESS = "trainer_last_success_timestamp_seconds"

# Alert rules, fixed values: alert, severity, what is measured, metric, second metric, comparator, limit, window, hold.
ALERT_RULES = [
    ("HighProcessingErrorRate", "critical", "share", FAILED, CONSUMED, ">", 0.05, 300.0, 300.0),
    ("HighKafkaConsumerLag", "warning", "value", LAG, None, ">", 1000.0, 0.0, 300.0),
    ("ProcessingDurationAnomaly", "warning", "mean", DURATION_SUM, DURATION_COUNT, ">", 5.0, 300.0, 300.0),
    ("ModelTrainingFailed", "warning", "increase", RUNS_FAILED, None, ">", 0.0, 3600.0, 600.0),
    ("ModelTrainingStale", "warning", "age", LAST_SUCCESS, None, ">", 43200.0, 0.0, 900.0),
    ("DatabaseWriteFailures", "critical", "rate", WRITES_FAILED, None, ">", 0.0, 300.0, 300.0),
]

# Error code ranges (first, last, family).
ERROR_FAMILIES = [
    (1, 99, "Scraper network errors"),
    (101, 199, "Scraper parsing errors"),
    (201, 299, "State management errors"),
    (301, 399, "Kafka producer errors"),
    (401, 499, "Kafka consumer errors"),
    (501, 599, "MongoDB connection errors"),
    (601, 699, "MongoDB write errors"),
    (701, 799, "MongoDB read errors"),
    (801, 899, "Model training data errors"),
    (901, 999, "Model training execution errors"),
    (1001, 1099, "Prediction input validation"),
    (1101, 1199, "Prediction execution errors"),
]
