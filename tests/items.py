"""Nine posts of four authors, as documents."""

from datetime import datetime, timezone

from graphloom.schemas import ITEMS


def day(n: int, month: int = 6) -> int:
    return int(datetime(2015, month, n, tzinfo=timezone.utc).timestamp() * 1000)


# item, parent, author, day of June 2015, url ids, hosts, mentioned, replied to (id, name)
_POSTS = [
    (1, None, 1, 1, [1, 2], ["host1", "host1"], 4, (2, "author2")),
    (2, 1, 2, 3, [4, 5], ["host3", "host3"], 4, (1, "author5")),
    (3, 1, 2, 4, None, None, None, None),
    (4, 1, 3, 5, None, None, None, None),
    (5, None, 2, 2, None, None, None, None),
    (6, 5, 3, 6, None, None, None, None),
    (7, 5, 1, 7, [2, 3], ["host1", "host2"], None, None),
    (8, 4, 2, 8, None, None, None, None),
    (9, 4, 4, 9, [3, 2], ["host2", "host1"], None, None),
]


def items(spark):
    by = {p[0]: p for p in _POSTS}
    rows = []
    for item, parent, nick, when, urls, hosts, mention, reply in _POSTS:
        up = by.get(parent)
        row = dict.fromkeys(ITEMS.names) | {
            "item_id": item, "item_title": f"title{item}", "item_link": f"link{item}", "item_body": f"body{item} text", "item_parentId": parent, "item_publishDate": day(when),
            "nick_id": nick, "nick_name": f"author{nick}", "item_activity": nick, "item_audience": 11 * nick, "item_referenceIds": urls, "item_site": hosts,
        }
        if mention:
            row |= {"item_mentionNickId": [mention], "item_mentionNickName": [f"author{mention}"], "item_mentionNickActivity": [mention], "item_mentionNickAudience": [11 * mention]}
        if reply:
            row |= {"item_replyNickId": [reply[0]], "item_replyNickName": [reply[1]], "item_replyNickActivity": [reply[0]], "item_replyNickAudience": [11 * reply[0]]}
        if up:
            row |= {"item_parentPublishDate": day(up[3]), "item_parentLink": f"link{parent}", "item_parentNickId": up[2], "item_parentNickName": f"author{up[2]}", "item_parentNickActivity": up[2], "item_parentAudience": 11 * up[2]}
        rows.append(tuple(row[n] for n in ITEMS.names))
    return spark.createDataFrame(rows, ITEMS)
