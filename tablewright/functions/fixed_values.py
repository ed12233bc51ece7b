"""Option words, result labels and symbols that users of the operators rely on."""

# --- fixed values -----------------------------------------------------------------------------

# Symbols that row splitting recognises when no delimiter is given.
SPLIT_SYMBOLS = ["/", "-", "_", "#", "@", "!", "$", "|", "=", ",", ".", "*"]

# Sort direction words.
ASCENDING = "升序"
DESCENDING = "降序"

# Fill strategy words.
FILL_MEAN = "均值填充"
FILL_MAX = "最大值填充"
FILL_MIN = "最小值填充"

# Row labels of the full-table statistics, in report order.
STATISTIC_LABELS = [
    "类型", "总数", "最小值", "最小值位置", "25%分位数", "中位数", "75%分位数", "均值",
    "最大值", "最大值位置", "平均绝对偏差", "方差", "标准差", "偏度", "峰度",
]

# Count column of the frequency report.
FREQUENCY_LABEL = "频率"

# Columns and rows of the binary evaluation report.
METRIC_LABEL = "指标"
VALUE_LABEL = "值"
METRIC_CORRECT = "正确个数"
METRIC_ACCURACY = "精准度"
METRIC_PR = "Area under PR"
METRIC_ROC = "Area under ROC"

# Default output column names.
QUANTILE_SUFFIX = "(分位数离散化)"
ROW_SPLIT_SUFFIX = "拆分"
PCA_NAME = "降维结果"
CHI_SQUARE_NAME = "卡方选择(与 [{}] 相关的前 {} 个特征列)"
VECTOR_INDEX_SUFFIX = "_vectorIndexer"
SCALE_SUFFIX = "_standardScaler"
STRING_INDEX_SUFFIX = "_string_indexer"
ONE_HOT_SUFFIX = "_oneHot"
POLYNOMIAL_SUFFIX = "_PolynomialExpansion"

# Operator codes of declared flows.
FILTER, SORT, SPLIT_COLUMN, SPLIT_ROWS = 1001, 1002, 1003, 1004
MERGE_COLUMNS, REPLACE, FILL_NULLS, MAP_COLUMNS, RANDOM_SPLIT = 1005, 1006, 1007, 1008, 1009
QUANTILE_BINS, VECTOR_INDEX, STANDARD_SCALE, PCA_PROJECT = 2001, 2002, 2003, 2004
STRING_INDEX, ONE_HOT, POLYNOMIAL, CHI_SQUARE = 2005, 2006, 2007, 2008
DESCRIBE, FREQUENCY, CORRELATION = 3001, 3002, 3003
READ = 5001
PREDICT, SVM, GBT, LR_BINARY, LR_MULTI, MLP = 6000, 6001, 6002, 6003, 6004, 6005
EVALUATE = 7001
LOAD_MODEL = 8000
