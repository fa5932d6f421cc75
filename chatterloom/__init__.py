"""Conversation analytics as DataFrame-to-DataFrame operators on Spark."""

from chatterloom.config import Settings
from chatterloom.plans.analysis import ConversationAnalysis, analyze_conversations

__all__ = ["ConversationAnalysis", "Settings", "analyze_conversations"]
