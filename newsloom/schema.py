"""Tables of the news ontology: columns, keys, references and allowed values."""

from __future__ import annotations

# Enumerations of the data model.
EVENT_TYPES = ("political", "economic", "military", "diplomatic", "social", "technological", "environmental")
IMPORTANCE = ("routine", "notable", "major", "critical")
STATUS = ("emerging", "developing", "peak", "declining", "resolved", "archived")
ROLES = ("primary_actor", "mentioned", "affected")
RELATIONS = ("causal", "thematic", "sequential")
ORG_TYPES = ("government", "military", "enterprise", "international", "media", "academic")
REVIEW_LABELS = ("SAME_EVENT", "RELATED_NOT_SAME", "DIFFERENT_EVENT", "UNSURE")
CATEGORY_TYPES = {"economy": "economic", "politics": "political", "military": "military", "technology": "technological", "culture": "social", "environment": "environmental"}

TABLES = {
    "news_item": "news_id string, title string, full_text string, broadcast_date date, order_in_broadcast int, summary string, keywords array<string>, tags string, url string, word_count int",
    "person": "person_id string, name string, name_chinese string, title string, organization_id string",
    "organization": "org_id string, name string, type string",
    "topic": "topic_id string, name string, category string",
    "news_person": "news_id string, person_id string",
    "news_organization": "news_id string, org_id string",
    "news_topic": "news_id string, topic_id string, relevance_score double, is_primary boolean",
    "news_event": "event_id string, name string, type string, importance string, status string, first_date date, last_date date, news_count long, summary string, heat_score double",
    "news_event_link": "news_id string, event_id string",
    "event_person": "event_id string, person_id string, role string",
    "event_organization": "event_id string, org_id string, role string",
    "event_relation": "source_event_id string, target_event_id string, similarity_score double, relation_type string, time_interval_days int",
}

#: References between the tables: table and column, the table and column that they lead to.
REFERENCES = (
    ("person", "organization_id", "organization", "org_id"),
    ("news_person", "news_id", "news_item", "news_id"), ("news_person", "person_id", "person", "person_id"),
    ("news_organization", "news_id", "news_item", "news_id"), ("news_organization", "org_id", "organization", "org_id"),
    ("news_topic", "news_id", "news_item", "news_id"), ("news_topic", "topic_id", "topic", "topic_id"),
    ("news_event_link", "news_id", "news_item", "news_id"), ("news_event_link", "event_id", "news_event", "event_id"),
    ("event_person", "event_id", "news_event", "event_id"), ("event_person", "person_id", "person", "person_id"),
    ("event_organization", "event_id", "news_event", "event_id"), ("event_organization", "org_id", "organization", "org_id"),
    ("event_relation", "source_event_id", "news_event", "event_id"), ("event_relation", "target_event_id", "news_event", "event_id"),
)

#: What an enrichment provider returns for an item, after the shapes it may take are made uniform.
ENRICHMENT = "summary string, keywords array<string>, topics array<struct<name:string,relevance:double>>, people array<struct<name:string,title:string>>, organizations array<struct<name:string,type:string>>, entities string, signals string, policy_signals array<struct<signal:string,type:string,evidence:string>>"
