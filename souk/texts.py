"""Message texts of the analytics, shared with their SQL twins."""

# fixed values: results must carry these texts word for word
NARRATIVE = {
    "headline 0": "%.1f Cr revenue across %s orders - %s & %s zone lead growth.",
    "insight 1": "**%s** is the highest-revenue category, driving outsized contribution to total sales.",
    "insight 2": "**%s zone** leads all regions - logistics and marketing investment here yields highest ROI.",
    "insight 3": "Festival periods account for **%.0f%%** of total revenue - seasonal planning is critical.",
    "insight 4": "Average discount of **%.1f%%** is costing %.1f Cr in foregone revenue.",
    "insight 5": "Premium brands represent **%.0f%%** of revenue - premiumisation trend %s.",
    "insight 6": "Revenue is **%s** month-over-month at **%+.1f%%**.",
    "risk 1": "Average discount (%.1f%%) is above sustainable threshold - margin erosion risk.",
    "risk 2": "Over %.0f%% revenue concentrated in festival periods - high seasonality risk.",
    "risk 3": "High-competition segments show %.1f%% avg discount - price war signal.",
    "risk 4": "Revenue declined %.1f%% last month - investigate root cause immediately.",
    "risk 5": "No critical risks detected in current data window.",
    "opportunity 1": "Reducing average discount by 5pp could recover ~%.1f Cr in annual revenue.",
    "opportunity 2": "Premium brands at %.0f%% of revenue - targeted upsell campaigns could push this to 50%%+.",
    "opportunity 3": "%s zones are underperforming - geo-targeted promotions could unlock growth.",
    "opportunity 4": "40%+ orders show high inventory pressure - demand forecasting investment would reduce stockouts.",
}
RECOMMENDATIONS = {
    "action pricing": "Reduce discount on %s by 5-8pp during non-festival periods",
    "impact pricing": "Est. %.1f Cr revenue recovery",
    "action 3": "Pre-stock top categories 6 weeks before festival months (%s)",
    "impact 3": "Prevent stockouts during peak demand - protect 15-25% of annual revenue",
    "action 4": "Launch geo-targeted campaign in %s zone (currently %.0f%% of %s)",
    "impact 4": "10% lift in bottom zone = meaningful incremental revenue",
    "action 5": "Bundle premium products with mass bestsellers - increase premium attach rate",
    "impact 5": "Premium at %.0f%% - target 50%% = higher AOV and margins",
    "action 6": "Launch loyalty programme targeting top 20% customers by CLV",
    "impact 6": "5% retention improvement = 25-95% profit increase (Bain & Co benchmark)",
    "action 7": "Shift high-competition SKUs toward value-added bundles rather than pure discounting",
    "impact 7": "Protect margins while maintaining conversion in competitive segments",
}
ELASTICITY_CLASSES = {
    "elastic": "Elastic (< -1)",
    "inelastic": "Inelastic (-1 to 0)",
    "giffen": "Giffen / Luxury (> 0)",
}
DISCOUNT_ADVICE = {
    "elastic": "Aggressive discounting justified - demand is elastic",
    "inelastic": "Moderate discounts - demand is inelastic, protect margins",
    "giffen": "Luxury / Giffen signal - discounting may reduce perceived value",
}
DISCOUNT_RATIONALE = {
    "giffen": "Giffen/luxury good - discounting may reduce demand",
    "other": "Elasticity %.2f - %s",
    "elastic": "elastic: increase discount to grow volume",
    "inelastic": "inelastic: reduce discount to protect margin",
}
ALERT_TEXTS = {
    "CRITICAL": "Reorder %s in %s immediately",
    "HIGH": "Increase safety stock for %s - %s",
    "CLEARANCE": "Run targeted promotion to clear %s - %s",
    "SLOW_MOVER": "Review pricing / listing quality for %s - %s",
    "HEALTHY": "No action required",
}
CUSTOMER_ACTIONS = {
    "critical, high value": "Immediate outreach - offer %.0f%% personalised discount on %s",
    "high, high value": "Send win-back email with loyalty reward for %s purchase",
    "mid value": "Trigger re-engagement campaign - highlight new arrivals in %s",
    "other": "Add to re-engagement drip sequence",
}
