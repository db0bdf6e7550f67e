"""Column lists and types of the result tables."""

from pyspark.sql import types as T

_TYPES = {
    "Key_Weight": T.IntegerType(),
    "SKey_Count": T.DoubleType(),
    "Entropy": T.DoubleType(),
    "Dictionary_Similarity": T.DoubleType(),
    "Score": T.DoubleType(),
    "Year": T.IntegerType(),
    "Month": T.IntegerType(),
    "Day": T.IntegerType(),
    "Hour": T.IntegerType(),
    "Label": T.IntegerType(),
}

# The column names and their order.
_SCORES = ["Key_Weight", "SKey_Count", "Entropy", "Dictionary_Similarity", "Score"]
_TIME = ["Year", "Month", "Day", "Hour"]
_BODY = ["Secret", "Code", "Detected_Timestamp", *_SCORES, *_TIME]

PUBLIC_DETECTIONS = [
    "Source", "Primary_Key", "Second_Key", "Extension", "URL", "Owner", "Repo_Name",
    "Commit_Details", *_BODY,
]
ENTERPRISE_DETECTIONS = [c for c in PUBLIC_DETECTIONS if c != "Primary_Key"]
PUBLIC_COLLECTOR = [c for c in PUBLIC_DETECTIONS if c != "Commit_Details"]
ENTERPRISE_COLLECTOR = [c for c in ENTERPRISE_DETECTIONS if c != "Commit_Details"]
FILE_DETECTIONS = ["Source", "Second_Key", "Extension", "URL", *_BODY]
FILE_UNIQUE = ["Source", "Second_Key", "Extension", "URL", "Code"]
KEYWORD_DETECTIONS = [
    "Source", "Second_Key", "URL", "Owner", "Repo_Name", "Commit_Details",
    "Detected_Timestamp", *_TIME,
]
TRAINING_SOURCE = ["Secret", "Second_Key", "Extension", "Code", *_SCORES, "Label"]

URL_LEDGER = ["hashed_url", "url"]
FILE_LEDGER = ["hashed_files", "file_modification_hash", "files"]
SCANNED_VERSIONS = ["html_url", "indexed_at", "file_id", "search"]


def struct(columns):
    """StructType for one of the column lists above."""
    return T.StructType([T.StructField(c, _TYPES.get(c, T.StringType())) for c in columns])


SEARCH_RESULT = T.StructType(
    [
        T.StructField("html_url", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField(
            "repository", T.StructType([T.StructField("full_name", T.StringType())])
        ),
        T.StructField("indexed_at", T.TimestampType()),
    ]
)

COMMITS_RAW = T.StructType(
    [
        T.StructField("owner", T.StringType()),
        T.StructField("repo", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("body", T.StringType()),
    ]
)

COMMIT_BODY = T.ArrayType(
    T.StructType(
        [
            T.StructField("sha", T.StringType()),
            T.StructField(
                "commit",
                T.StructType(
                    [
                        T.StructField(
                            "author",
                            T.StructType(
                                [
                                    T.StructField("email", T.StringType()),
                                    T.StructField("name", T.StringType()),
                                    T.StructField("date", T.StringType()),
                                ]
                            ),
                        )
                    ]
                ),
            ),
            T.StructField(
                "author", T.StructType([T.StructField("login", T.StringType())])
            ),
        ]
    )
)
