"""Wording of the findings and inefficiency reports."""

# Report sentences, filled in with format_string.
CVR_CHANNEL_FINDING = "%s shows a CVR difference between %s (CVR: %.4f) and %s (CVR: %.4f)."
CVR_CHANNEL_ACTION = (
    "Investigate user experience on %s for %s to identify friction points and optimize conversion funnel. "
    "Consider reallocating budget from lower performing device to higher performing one within this channel."
)
CVR_USER_FINDING = "New users have a CVR of %.4f while returning users have %.4f."
CVR_USER_ACTION = (
    "Tailor marketing messages and landing pages specifically for new users to improve their initial conversion "
    "journey. For returning users, focus on loyalty programs or personalized recommendations."
)
CVR_CITY_FINDING = "City Tier %s has the highest CVR of %.4f, while City Tier %s has the lowest at %.4f."
CVR_CITY_ACTION = (
    "Study successful campaigns and user behavior in City Tier %s and apply learnings to optimize strategies for "
    "City Tier %s. Consider localized promotions."
)
ROAS_CHANNEL_FINDING = "%s shows a ROAS difference between %s (ROAS: %.4f) and %s (ROAS: %.4f)."
ROAS_CHANNEL_ACTION = (
    "Reallocate ad spend from %s on %s to %s on %s or other high-performing segments to maximize return."
)
ROAS_USER_FINDING = "New users have a ROAS of %.4f while returning users have %.4f."
ROAS_USER_ACTION = (
    "Investigate why ROAS differs between new and returning users. If new user ROAS is lower, consider optimizing "
    "initial ad creatives and targeting to attract more profitable new customers. If returning user ROAS is lower, "
    "focus on remarketing strategies."
)
ROAS_CITY_FINDING = "City Tier %s has the highest ROAS of %.4f, while City Tier %s has the lowest at %.4f."
ROAS_CITY_ACTION = (
    "Evaluate ad spend efficiency in lower performing City Tier %s. Perhaps re-evaluate campaign goals or adjust "
    "bidding strategies in these areas, or explore alternative channels for better ROAS."
)

# Inefficiency area 1, the costliest wasted campaign-day.
CAMPAIGN_AREA = "Campaign %s (%s)"
CAMPAIGN_DESCRIPTION = (
    "Campaign %s on the %s channel has a high spend of %.2f but a very low ROAS of %.2f, indicating that every "
    "dollar spent brings back %.2f dollars of revenue."
)
CAMPAIGN_REASONS = (
    "Poor targeting: Ads reaching irrelevant audience.",
    "Irrelevant ad copy/creative: Ads not resonating with the audience or not matching landing page content.",
    "High competition/CPC: Bidding too high on competitive keywords, driving up spend without proportional returns.",
    "Poor landing page experience: Users clicking but not converting due to bad landing page design, slow load "
    "times, or confusing content.",
    "Product/offer mismatch: The product or offer being promoted is not appealing to the audience attracted by the "
    "campaign.",
)
CAMPAIGN_EXPERIMENTS = (
    "A/B Test Ad Creatives/Copy: Test different ad headlines, descriptions, and call-to-actions to see which ones "
    "drive higher conversion rates and ROAS.",
    "Audience Segmentation Refinement: Experiment with more granular audience targeting based on demographics, "
    "interests, and behaviors to reach more qualified leads.",
    "Landing Page Optimization: Test different landing page designs, content layouts, and offer placements to "
    "improve on-page conversion rates.",
    "Keyword Optimization (for search campaigns): Review and prune underperforming keywords, reallocate budget to "
    "high-performing keywords, and test long-tail keywords.",
)

# Inefficiency area 2, the channel and device with the lowest ROAS.
SEGMENT_AREA = "Channel: %s, Device: %s"
SEGMENT_DESCRIPTION = (
    "The %s channel on %s devices exhibits the lowest ROAS (%.2f), indicating significant inefficiency in ad spend "
    "for this segment."
)
SEGMENT_REASONS = (
    "Mobile user experience issues: Website/app not optimized for mobile, leading to high bounce rates and low "
    "conversions.",
    "Ad creative not suited for mobile: Ads are not visually appealing or engaging on smaller screens.",
    "Targeting mismatch: The mobile audience targeted by paid social campaigns may not be as conversion-ready as "
    "other segments.",
    "Slow mobile page load times: Users abandoning before content loads due to poor performance.",
    "Difficulty completing purchases on mobile: Complex checkout processes or forms on mobile.",
)
SEGMENT_EXPERIMENTS = (
    "Mobile-Specific Creative Testing: Design and test ad creatives specifically optimized for mobile platforms "
    "(e.g., short-form videos, interactive ads).",
    "Improve Mobile Landing Page Experience: Optimize landing pages for faster load times, intuitive navigation, and "
    "simplified forms on mobile devices.",
    "A/B Test Mobile CTA and Layout: Experiment with different call-to-action placements and overall layout specific "
    "to mobile screens.",
    "Refine Mobile Targeting: Adjust audience targeting parameters to focus on mobile users who are more likely to "
    "convert, potentially excluding segments with consistently low ROAS.",
)
