"""Fixed schemas of the tables that the engine keeps."""

from __future__ import annotations

#: Names and types of catalogue, log, features and the feedback store.
ITEMS = "item_id string, title string, brand string, category string, price string, description string, image_url string"
HISTORY = "user_id string, item_id string, ts long, source string"
FEATURES = "item_id string, text_vec array<float>, image_vec array<float>"
RAW_ITEMS = "parent_asin string, asin string, title string, parent_title string, product_title string, store string, categories string, price string, description string, images string, image_url string, imageURLHighRes string, imageURL string"
RAW_REVIEWS = "user_id string, parent_asin string, asin string, timestamp long, unixReviewTime long"
USERS = "user_id string, nickname string, password_hash string, avatar_url string, created_at timestamp, last_active timestamp, status string"
USER_INTERESTS = "user_id string, category string, tag string, weight double, updated_at timestamp"
USER_FEEDBACK = "feedback_id long, user_id string, item_id string, liked boolean, comment_text string, rating int, shown_at timestamp, interacted_at timestamp"
EXPOSURES = "exposure_id long, user_id string, item_id string, shown_at timestamp, interacted boolean"
PREFERENCES = "user_id string, vector array<float>, short_term array<float>, long_term array<float>, history array<string>, updated_at timestamp"
TAGS = "category string, tag string, description string"
TAG_EMBEDDINGS = "tag string, v array<float>"
STORE = {"users": USERS, "user_interests": USER_INTERESTS, "user_feedback": USER_FEEDBACK, "exposure_history": EXPOSURES, "user_preference_vectors": PREFERENCES, "interest_tags": TAGS, "tag_embeddings": TAG_EMBEDDINGS}
EXTENSIONS = ("jpg", "jpeg", "png", "webp")
