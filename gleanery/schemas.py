"""Declared schemas of the tables that jobs read and write."""

from pyspark.sql import types as T

_ITEM_FIELDS = [
    T.StructField("source_type", T.StringType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("published_date", T.TimestampNTZType(), False),
    T.StructField("content", T.StringType(), True),
    T.StructField("transcript", T.StringType(), True),
]

ITEM_BATCH = T.StructType(_ITEM_FIELDS)

ITEMS = T.StructType(
    [*_ITEM_FIELDS, T.StructField("created_at", T.TimestampNTZType(), False)]
)

ITEM_KEYS = ["source_type", "id"]
ITEM_VALUES = [
    "title",
    "description",
    "url",
    "published_date",
    "content",
    "transcript",
]

SUMMARIES = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("title", T.StringType(), False),
        T.StructField("source_id", T.StringType(), False),
        T.StructField("source_type", T.StringType(), False),
        T.StructField("summary_text", T.StringType(), False),
        T.StructField("summary_vector", T.ArrayType(T.DoubleType()), True),
        T.StructField("article_created_at", T.TimestampNTZType(), False),
        T.StructField("created_at", T.TimestampNTZType(), False),
    ]
)

PROFILES = T.StructType(
    [
        T.StructField("profile_id", T.StringType(), False),
        T.StructField("name", T.StringType(), True),
        T.StructField("background", T.StringType(), True),
        T.StructField("teams", T.ArrayType(T.StringType()), True),
        T.StructField("players", T.ArrayType(T.StringType()), True),
        T.StructField("interests", T.ArrayType(T.StringType()), True),
        T.StructField("preferences", T.MapType(T.StringType(), T.BooleanType()), True),
    ]
)

SCORES = T.StructType(
    [
        T.StructField("profile_id", T.StringType(), False),
        T.StructField("summary_id", T.StringType(), False),
        T.StructField("relevance_score", T.DoubleType(), True),
        T.StructField("rank", T.IntegerType(), True),
        T.StructField("reasoning", T.StringType(), True),
    ]
)

RANKED_COLUMNS = [
    "profile_id",
    "id",
    "title",
    "summary",
    "url",
    "source_id",
    "source_type",
    "article_created_at",
    "rank",
    "relevance_score",
    "reasoning",
]

# RSS and Atom entries as the XML source delivers them; Atom without name prefixes.
RSS_ENTRY = T.StructType(
    [
        T.StructField(
            "guid",
            T.StructType(
                [
                    T.StructField("_VALUE", T.StringType()),
                    T.StructField("_isPermaLink", T.StringType()),
                ]
            ),
        ),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("pubDate", T.StringType()),
    ]
)

ATOM_ENTRY = T.StructType(
    [
        T.StructField("videoId", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField(
            "link", T.StructType([T.StructField("_href", T.StringType())])
        ),
        T.StructField("published", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField(
            "group",
            T.StructType([T.StructField("description", T.StringType())]),
        ),
    ]
)
