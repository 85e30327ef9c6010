"""The type of a site, by points for the signals of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Embeds and menu words that tell types apart.
GAME_FRAMES = r"game|play|html5|unity|gamedistribution|gameflare|gamepix|crazygames|poki|y8|friv|itch\.io|htmlgames"
VIDEO_FRAMES = r"youtube\.com/embed|youtube-nocookie\.com|youtu\.be|player\.vimeo\.com|player\.bilibili\.com|dailymotion\.com/embed|embed\.twitch\.tv|streamable\.com/o|wistia.*\.net/medias|vidyard\.com/embed|brightcove"
MENU = {
    "game": ("games?|play|arcade|puzzle|action", "游戏|玩游戏"),
    "tool": ("calculator|converter|generator|tool|translat|calculat|checker|analyzer|formatter|validator|encoder|decoder", "计算器|转换器|工具|翻译"),
    "reference": (r"wiki|encyclopedia|reference|glossary|docs|documentation|knowledge\s*base|archive|database|transcript", "百科|知识库|参考|词典|文档|数据库|档案"),
    "video": ("video|videos|watch|channel|channels|stream|vlog|clip|playlist|shorts|tv", "视频|频道|直播|短视频"),
}


def has_word(text: Column, kind: str) -> Column:
    en, zh = MENU[kind]
    return text.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{en})(?![A-Za-z0-9_])") | text.rlike(zh)


def site_features(signals: DataFrame, meta: DataFrame) -> DataFrame:
    """Per site: shares of pages with each signal, and what its home page shows."""
    df = signals.join(meta.select("page_id", F.concat_ws(" ", "nav_text", "footer_text").alias("menu")), "page_id")
    any_frame = lambda p: F.exists("iframe_srcs", lambda s: s.rlike(f"(?i){p}"))
    count = lambda p: F.size(F.filter("iframe_srcs", lambda s: s.rlike(f"(?i){p}")))
    df = df.withColumns({"video_frame": any_frame(VIDEO_FRAMES), "game_frame": any_frame(GAME_FRAMES), "video_frames": count(VIDEO_FRAMES)})
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    first = lambda c: F.min_by(c, "page_id")
    return df.groupBy("site").agg(
        F.count("*").alias("n_pages"),
        share(F.col("video_frame")).alias("video_frame_share"),
        share(F.col("videos") > 0).alias("video_share"),
        share(F.col("game_frame")).alias("game_frame_share"),
        share(F.col("iframes") > 0).alias("frame_share"),
        share(F.col("canvases") > 0).alias("canvas_share"),
        share(F.col("articles") > 0).alias("article_share"),
        F.avg("game_links").alias("game_links"),
        F.sum("game_links").alias("all_game_links"),
        first("video_frames").alias("home_video_frames"),
        first("iframes").alias("home_frames"),
        first("canvases").alias("home_canvases"),
        first("menu").alias("menu"),
    )


def site_type(features: DataFrame, manual: str | None = None) -> DataFrame:
    """site, n_pages, type, confidence and the three point counts; a manual type wins."""
    c, menu = F.col, F.col("menu")
    step = lambda x, *levels: _steps(x, levels)
    word = lambda k, n: F.when(has_word(menu, k), n).otherwise(0)
    video = step(c("video_frame_share"), (0.3, 5), (0.1, 3)) + step(c("video_share"), (0.3, 5), (0.1, 3)) + word("video", 3) + step(c("home_video_frames"), (3, 3), (1, 1))
    links = F.when(c("game_links") >= 5, 3).when(c("game_links") >= 2, 2).when(c("all_game_links") >= 3, 1).otherwise(0)
    frames = F.when(c("frame_share") >= 0.3, 2).when(c("home_frames") >= 1, 1).otherwise(0)
    game = step(c("game_frame_share"), (0.3, 5), (0.1, 3)) + frames + step(c("canvas_share"), (0.1, 4)) + step(c("home_canvases"), (1, 3)) + word("game", 3) + step(c("home_frames"), (3, 3)) + links
    game = game - F.when((c("article_share") >= 0.7) & (game < 3), 2).otherwise(0)
    reference = step(c("article_share"), (0.7, 3), (0.5, 1)) + word("reference", 3) + F.when(c("frame_share") < 0.1, 1).otherwise(0)
    df = features.withColumns({"video_points": video.cast("long"), "game_points": game.cast("long"), "reference_points": reference.cast("long"), "tool": has_word(menu, "tool")})
    sure = lambda p: F.when(c(p) >= 6, "high").otherwise("medium")
    kind = F.when(c("video_points") >= 3, "video").when(c("game_points") >= 3, "game").when(c("tool"), "tool").when(c("reference_points") >= 3, "reference").otherwise("content")
    trust = F.when(c("video_points") >= 3, sure("video_points")).when(c("game_points") >= 3, sure("game_points")).when(c("tool"), "medium").when(c("reference_points") >= 3, sure("reference_points")).otherwise("high")
    if manual:
        kind, trust = F.lit(manual), F.lit("high")
    return df.select("site", "n_pages", kind.alias("type"), trust.alias("confidence"), "video_points", "game_points", "reference_points")


def _steps(x: Column, levels: tuple) -> Column:
    out = F.when(x >= levels[0][0], levels[0][1])
    for least, points in levels[1:]:
        out = out.when(x >= least, points)
    return out.otherwise(0)
