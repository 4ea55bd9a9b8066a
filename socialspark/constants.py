"""Column names, calendar, export headers and keyword lists."""

from __future__ import annotations

# --- fixed values: these must equal the values used to collect the data ---

CREATED_AT = "created_at"
POST_ID = "external_id"
CLEAN_TEXT = "clean_content"

MONTHS = ["2024-05", "2024-06", "2024-07", "2024-08", "2024-09", "2024-10", "2024-11"]
STUDY_SINCE = "2024-05"
STUDY_UNTIL = "2024-12"  # exclusive

EMBEDDING_DIMENSIONS = 128
EMBEDDING_PROMPT = (
    "Instruct: Compute a representation for this sentence that captures its semantic"
    " meaning for the purpose of clustering.\n"
    "Sentence:"
)

LABEL_INSTRUCTIONS = (
    "You are labeling a cluster of social media posts for topic modeling.\n"
    "Return a short label (2–6 words) and a 1–2 sentence description.\n"
    "Avoid political bias; label the dominant theme.\n"
)

X_KEYWORDS = [
    "2024 Elections", "2024 Presidential Election", "Biden", "Biden2024", "CPAC",
    "Cornel West", "DNC", "Dean Phillips", "Democratic party", "Donald Trump", "GOP",
    "Green Party", "Independent Party", "Jill Stein", "Joe Biden",
    "Joe Biden and Kamala Harris", "Joseph Biden", "KAG", "Kamala Harris", "MAGA",
    "Marianne Williamson", "Nikki Haley", "No Labels", "RFK Jr", "RNC",
    "Republican party", "Robert F. Kennedy Jr.", "Ron DeSantis", "Snowballing",
    "Third Party", "Trump2024", "US Elections", "Vivek Ramaswamy", "bidenharris2024",
    "conservative", "letsgobrandon", "makeamericagreatagain", "phillips2024",
    "thedemocrats", "trumpsupporters", "trumptrain", "ultramaga", "voteblue2024",
    "williamson2024",
]
TS_KEYWORDS = [
    "2024Elections", "2024PresidentialElections", "2024USElections", "Biden",
    "Biden2024", "CPAC", "CornellWest", "DNC", "Democraticparty", "DonaldTrump", "GOP",
    "GreenParty", "IndependentParty", "JillStein", "JoeBiden", "JosephBiden", "KAG",
    "KamalaHarris", "MAGA", "MarianneWilliamson", "DeanPhillips", "NikkiHaley",
    "NoLabels", "RFKJr", "RNC", "Republicanparty", "RobertF.KennedyJr.",
    "RonDeSantis", "ThirdParty", "Trump2024", "USElections", "VivekRamaswamy",
    "bidenharris2024", "conservative", "democratsoftiktok", "letsgobrandon",
    "makeamericagreatagain", "phillips2024", "republicansoftiktok", "thedemocrats",
    "trumpsupporters", "trumptrain", "ultramaga", "voteblue2024", "williamson2024",
]
TAG_KEYWORDS = [
    "2024elections", "2024presidentialelection", "2024presidentialelections", "biden",
    "biden2024", "bidenharris2024", "conservative", "cpac", "cornelwest",
    "joebidenandkamalaharris", "deanphillips", "democraticparty", "dnc", "donaldtrump",
    "gop", "greenparty", "independentparty", "jillstein", "joebiden", "josephbiden",
    "kag", "kamalaharris", "letsgobrandon", "maga", "makeamericagreatagain",
    "mariannewilliamson", "nikkihaley", "nolabels", "phillips2024", "republicanparty",
    "rfkjr", "rnc", "robertf.kennedyjr.", "rondesantis", "thedemocrats", "thirdparty",
    "trump2024", "trumpsupporters", "trumptrain", "ultramaga", "uselections",
    "vivekramaswamy", "voteblue2024", "williamson2024",
]
SEARCH_KEYWORDS = [
    "2024 Elections", "2024Elections", "2024 Presidential Election",
    "2024PresidentialElections", "2024USElections", "US Elections", "USElections",
    "Biden", "Joe Biden", "JoeBiden", "Joseph Biden", "JosephBiden", "Biden2024",
    "bidenharris2024", "Donald Trump", "DonaldTrump", "Trump2024", "trumpsupporters",
    "trumptrain", "conservative", "republicansoftiktok", "democratsoftiktok", "CPAC",
    "GOP", "KAG", "MAGA", "ultramaga", "Nikki Haley", "NikkiHaley", "Ron DeSantis",
    "RonDeSantis", "RNC", "DNC", "thedemocrats", "the democrats", "Democratic party",
    "Democraticparty", "Republican party", "Republicanparty", "Third Party",
    "ThirdParty", "Green Party", "GreenParty", "Independent Party", "IndependentParty",
    "No Labels", "NoLabels", "Kamala Harris", "KamalaHarris",
    "Joe Biden and Kamala Harris", "Marianne Williamson", "MarianneWilliamson",
    "Dean Phillips", "DeanPhillips", "williamson2024", "phillips2024", "RFK Jr",
    "RFKJr", "Robert F. Kennedy Jr.", "RobertF.KennedyJr.", "Jill Stein", "JillStein",
    "Cornel West", "CornellWest", "voteblue2024", "letsgobrandon",
    "makeamericagreatagain", "Vivek Ramaswamy", "VivekRamaswamy", "Snowballing",
]
# A group holds when any of its terms holds; a tuple needs all of its terms;
# a trailing * matches any word ending.
KEYWORD_GROUPS = {
    "elections": [
        "2024 election*", "2024election*", "us election*", "uselection*",
        "2024 presidential election*", "2024presidentialelection*",
    ],
    "biden_harris": [
        "biden", "biden2024", "joe biden", "joebiden", "joseph biden", "josephbiden",
        "bidenharris2024", ("joe biden", "kamala harris"),
    ],
    "trump": [
        "trump", "trump2024", "donald trump", "donaldtrump", "trumpsupport*", "trumptrain",
    ],
    "harris": ["kamala harris", "kamalaharris"],
    "primary_candidates": [
        "nikki haley", "nikkihaley", "ron desantis", "rondesantis", "vivek ramaswamy",
        "vivekramaswamy",
    ],
    "kennedy": [
        "rfk*", "rfk jr", "rfkjr", "robert f kennedy", "robert f kennedy jr",
        "robertfkennedyjr*",
    ],
    "other_candidates": [
        "jill stein", "jillstein", "cornel west", "cornelwest", "cornellwest",
    ],
    "organisations": ["cpac", "gop", "rnc", "dnc", "maga", "ultramaga", "kag"],
    "parties": [
        "conservative", "republican*", "democrat*", "democratic party", "democraticparty",
        "republican party", "republicanparty", "third party", "thirdparty", "green party",
        "greenparty", "independent party", "independentparty", "no labels", "nolabels",
    ],
    "slogans": ["voteblue2024", "letsgobrandon", "makeamericagreatagain"],
    "tiktok": ["republicansoftiktok", "democratsoftiktok"],
}

MERGE_COLUMNS = [
    "url", "external_id", "author_username", "content", "associated_tags", "like_count",
    "is_reply", "reply_count", "Scraping Date", "tagged_accounts", "created_at", "keyword",
]
POST_FIELDS = [
    "keyword", "uri", "cid", "indexedAt", "createdAt", "text", "langs", "author_did",
    "replyCount", "repostCount", "likeCount", "quoteCount", "bookmarkCount",
    "reply_parent_uri", "reply_parent_cid", "reply_root_uri", "reply_root_cid",
]
AUTHOR_FIELDS = [
    "did", "handle", "display_name", "created_at", "avatar", "allow_subscriptions",
    "pronouns", "verification",
]

# Headers of the X exports: the 23 columns every export shares, and the six header
# shapes in the order of the files.
X_COMMON_COLUMNS = [
    "conversationId", "conversationIdStr", "date", "epoch", "hashtags", "id", "id_str",
    "lang", "likeCount", "links", "media", "mentionedUsers", "quoteCount", "quotedTweet",
    "rawContent", "replyCount", "retweetCount", "retweetedTweet", "text", "type", "url",
    "user", "viewCount",
]
X_SCHEMAS = {
    "schema_1": [
        "", "id", "text", "url", "epoch", "media", "retweetedTweet", "retweetedTweetID",
        "retweetedUserID", "id_str", "lang", "rawContent", "replyCount", "retweetCount",
        "likeCount", "quoteCount", "conversationId", "conversationIdStr", "hashtags",
        "mentionedUsers", "links", "viewCount", "quotedTweet", "in_reply_to_screen_name",
        "in_reply_to_status_id_str", "in_reply_to_user_id_str", "location", "cash_app_handle",
        "user", "date", "_type", "type",
    ],
    "schema_2": [
        "", "type", "id", "username", "text", "url", "epoch", "media", "retweetedTweet",
        "retweetedTweetID", "retweetedUserID", "id_str", "lang", "rawContent", "replyCount",
        "retweetCount", "likeCount", "quoteCount", "conversationId", "conversationIdStr",
        "hashtags", "mentionedUsers", "links", "viewCount", "quotedTweet",
        "in_reply_to_screen_name", "in_reply_to_status_id_str", "in_reply_to_user_id_str",
        "location", "cash_app_handle", "user", "date",
    ],
    "schema_3": [
        "", "type", "id", "username", "text", "url", "epoch", "media", "retweetedTweet",
        "retweetedTweetID", "retweetedUserID", "id_str", "lang", "rawContent", "replyCount",
        "retweetCount", "likeCount", "quoteCount", "conversationId", "conversationIdStr",
        "hashtags", "mentionedUsers", "links", "viewCount", "quotedTweet",
        "in_reply_to_screen_name", "in_reply_to_status_id_str", "in_reply_to_user_id_str",
        "location", "cash_app_handle", "user", "0", "date",
    ],
    "schema_4": [
        "", "type", "id", "username", "text", "url", "epoch", "media", "retweetedTweet",
        "retweetedTweetID", "retweetedUserID", "id_str", "lang", "rawContent", "replyCount",
        "retweetCount", "likeCount", "quoteCount", "conversationId", "conversationIdStr",
        "hashtags", "mentionedUsers", "links", "viewCount", "quotedTweet",
        "in_reply_to_screen_name", "in_reply_to_status_id_str", "in_reply_to_user_id_str",
        "location", "cash_app_handle", "user", "in_reply_to_user_id_str.1", "location.1",
        "cash_app_handle.1", "user.1", "date",
    ],
    "schema_5": [
        "type", "id", "username", "text", "url", "epoch", "id_str", "lang", "rawContent",
        "replyCount", "retweetCount", "likeCount", "quoteCount", "conversationId",
        "conversationIdStr", "hashtags", "mentionedUsers", "links", "retweetedTweet",
        "quotedTweet", "coordinates", "inReplyToTweetId", "inReplyToTweetIdStr",
        "inReplyToUser", "source", "sourceUrl", "sourceLabel", "media", "card", "cashtags",
        "viewCount", "place", "user", "epoch_dt", "date",
    ],
    "schema_6": [
        "0", "type", "id", "username", "text", "url", "epoch", "media", "retweetedTweet",
        "retweetedTweetID", "retweetedUserID", "id_str", "lang", "rawContent", "replyCount",
        "retweetCount", "likeCount", "quoteCount", "conversationId", "conversationIdStr",
        "hashtags", "mentionedUsers", "links", "viewCount", "quotedTweet",
        "in_reply_to_screen_name", "in_reply_to_status_id_str", "in_reply_to_user_id_str",
        "location", "cash_app_handle", "user", "date",
    ],
}

PROMPT_WORDS = "Top words (count): "
PROMPT_POSTS = "Sample posts:"
PROMPT_FORMAT = "Output format:\nLabel: <2-6 words>\nDescription: <1-2 sentences>\n"

# Spark's English stop words, in its order.
STOP_WORDS_ENGLISH = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
    her hers herself it its itself they them their theirs themselves what which who whom this that
    these those am is are was were be been being have has had having do does did doing a an the and
    but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here
    there when where why how all any both each few more most other some such no nor not only own
    same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll
    i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've
    they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't
    shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's
    what's when's where's who's why's would
""".split()

# --- end of fixed values ---
