"""Table schemas and fixed values of the data model."""

from pyspark.sql import types as T

MESSAGE_META = T.StructType([
    T.StructField("model", T.StringType()),
    T.StructField("source", T.StringType()),
])

CONVERSATIONS = T.StructType([
    T.StructField("conv_id", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("owner_id", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("checksum", T.StringType()),
    T.StructField("meta", T.StringType()),
])

# What the conversations table stores: one row per import of a conversation.
CONVERSATION_CHANGES = T.StructType([
    *CONVERSATIONS.fields,
    T.StructField("loaded_at", T.TimestampType()),
    T.StructField("archive", T.StringType()),
    T.StructField("ordinal", T.LongType()),
])

MESSAGES = T.StructType([
    T.StructField("conv_id", T.StringType(), False),
    T.StructField("msg_id", T.StringType(), False),
    T.StructField("role", T.StringType()),
    T.StructField("ts", T.TimestampType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("parent_id", T.StringType()),
    T.StructField("hash", T.StringType()),
    T.StructField("meta", MESSAGE_META),
])

MESSAGE_TAGS = T.StructType([
    T.StructField("conv_id", T.StringType(), False),
    T.StructField("msg_id", T.StringType(), False),
    T.StructField("tag", T.StringType(), False),
])

MESSAGE_EMBEDDINGS = T.StructType([
    T.StructField("conv_id", T.StringType(), False),
    T.StructField("msg_id", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("model", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
])

MESSAGE_ANALYTICS = T.StructType([
    T.StructField("conv_id", T.StringType(), False),
    T.StructField("msg_id", T.StringType(), False),
    T.StructField("sentiment", T.DoubleType()),
    T.StructField("entities", T.StringType()),
    T.StructField("topics", T.ArrayType(T.StringType())),
])

LOAD_REJECTS = T.StructType([
    T.StructField("archive", T.StringType()),
    T.StructField("ordinal", T.LongType()),
    T.StructField("conv_id", T.StringType()),
    T.StructField("msg_id", T.StringType()),
    T.StructField("reason", T.StringType()),
])

# Words of the stored messages with their stems.
VOCABULARY = T.StructType([
    T.StructField("word", T.StringType(), False),
    T.StructField("lexeme", T.StringType(), False),
])

TABLES = {
    "conversations": CONVERSATION_CHANGES,
    "messages": MESSAGES,
    "message_tags": MESSAGE_TAGS,
    "message_embeddings": MESSAGE_EMBEDDINGS,
    "message_analytics": MESSAGE_ANALYTICS,
    "load_rejects": LOAD_REJECTS,
    "vocabulary": VOCABULARY,
}

MESSAGE_KEY = ["conv_id", "msg_id"]
ROLES = ["user", "assistant", "system", "tool"]

# Words the topic map never reports.
TOPIC_STOP_WORDS = """
a an and are as at be but by for from has have he her here him his i in into is
it its me my of on or our she so that the their them there they this to we with
you your
""".split()

# The public English stop list used by full-text search.
SEARCH_STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him
his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of
at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when
where why how all any both each few more most other some such no nor not only own
same so than too very s t can will just don should now
""".split()
