"""Small seeded tables in the shape of the logical inputs, for tests and trials."""

from __future__ import annotations

import datetime
import random

from pyspark.sql import SparkSession

from rillway import schemas


def mock_tables(spark: SparkSession, users: int = 20, sessions: int = 5, actions: int = 30, products: int = 100, seed: int = 1, day: datetime.date | None = None) -> dict:
    """user_visit_action, user_info and product_info, registered as views; the same seed gives the same rows."""
    rng = random.Random(seed)
    date = (day or datetime.date(2024, 1, 1)).isoformat()
    visits = []
    for user in range(users):
        for s in range(sessions):
            session, hour = f"{rng.getrandbits(128):032x}", rng.randrange(24)
            for _ in range(rng.randrange(actions)):
                at = f"{date} {hour:02d}:{rng.randrange(60):02d}:{rng.randrange(60):02d}"
                row = dict.fromkeys(schemas.USER_VISIT_ACTION.names)
                row |= {"date": date, "user_id": user, "session_id": session, "page_id": rng.randrange(10), "action_time": at, "city_id": rng.randrange(10)}
                kind = rng.choice(("search", "click", "order", "pay"))
                if kind == "search":
                    row["search_keyword"] = f"kw{rng.randrange(10)}"
                elif kind == "click":
                    row |= {"click_category_id": rng.randrange(100), "click_product_id": rng.randrange(100)}
                else:
                    for part in ("category", "product"):
                        row[f"{kind}_{part}_ids"] = ",".join(str(rng.randrange(100)) for _ in range(rng.randrange(1, 4)))
                visits.append(tuple(row.values()))
    people = [(u, f"user{u}", f"name{u}", rng.randrange(60), f"professional{rng.randrange(100)}", f"city{rng.randrange(100)}", rng.choice(("male", "female"))) for u in range(users)]
    goods = [(p, f"product{p}", f'{{"product_status":{rng.randrange(2)}}}') for p in range(products)]
    made = {
        "user_visit_action": spark.createDataFrame(visits, schemas.USER_VISIT_ACTION),
        "user_info": spark.createDataFrame(people, schemas.USER_INFO),
        "product_info": spark.createDataFrame(goods, schemas.PRODUCT_INFO),
    }
    for name, df in made.items():
        df.createOrReplaceTempView(name)
    return made
