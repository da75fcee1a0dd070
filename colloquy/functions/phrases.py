"""Phrase lists of the test views (FIXTURES.md section 9)."""

# Fixed values.
P = [
    "Error: command not found: foo, please fix it?", "permission denied (EACCES) when writing the file", "the request timed out, deadline exceeded", "we decided to use parquet instead of csv",
    "no, that's wrong, always use the test database", "perfect, looks good, keep it", "readability is more important than speed here", "see https://example.com/a for details",
    "@s1 can you review this? thanks", "预算和报价发我一下，合作截止周五", "明天给你，我整理好发你", "结论：下午五点前合主分支", "太棒了，谢谢大家", "部署失败了，好烦，不好",
    "Claude and DeepSeek are compared with Kimi", "为什么报错，帮我修复数据库迁移的问题", "股票 600519 估值和财报", "# TODO: refactor the parser", "总结一下本周的统计和趋势报告", "don't stop, it is not bad",
    "skill 优化 v0.9.31", "rate limit 429, too many requests", "I prefer spark over pandas", "ok",
]
Q = ["🔥京东优惠券 https://u.example.com/x%d 复制这条", "🎁红包返利 https://u.example.com/y 还有吗？"]
