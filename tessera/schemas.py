"""Schemas of the raw entities: explicit, so scans are pruned and nothing is inferred."""

from __future__ import annotations

BUSINESS = (
    "business_id string, name string, address string, city string, state string, postal_code string, latitude double, longitude double, "
    "stars double, review_count long, is_open int, attributes map<string,string>, categories string, hours map<string,string>"
)
REVIEW = "review_id string, user_id string, business_id string, stars double, useful long, funny long, cool long, text string, date string"
USER = "user_id string, name string, review_count long, yelping_since string, useful long, funny long, cool long, fans long, elite string, average_stars double, friends string"
CHECKIN = "business_id string, date string"
TIP = "user_id string, business_id string, text string, date string, compliment_count long"
