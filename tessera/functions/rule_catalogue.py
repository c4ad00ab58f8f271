"""The rule catalogue."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    """A detection rule; ``flags`` are i (any case) and m (line anchors)."""

    number: int
    category: str
    severity: str
    flags: str
    message: str
    regex: str

    @property
    def inline(self) -> str:
        """The pattern with its flags written in it."""
        return f"(?{self.flags}){self.regex}" if self.flags else self.regex


# Number, category, severity, flags, message and pattern of every rule.
RULES: tuple[Rule, ...] = (
    Rule(0, "http_exfiltration", "high", "i", "HTTP POST/PUT/PATCH request detected", r"(requests|httpx|urllib)\s*\.\s*(post|put|patch)\s*\("),
    Rule(1, "http_exfiltration", "critical", "i", "Known exfiltration service URL", r"""https?://[^\s\'"]+\.(ngrok|burpcollaborator|requestbin|pipedream|webhook\.site|hookbin|canarytokens|interactsh)"""),
    Rule(2, "http_exfiltration", "high", "i", "HTTP request to raw IP address", r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}[:/]"),
    Rule(3, "http_exfiltration", "high", "i", "urllib.request.urlopen() with data — POST equivalent", r"""urllib\.request\.urlopen\s*\([^,)]+,\s*(data|b["\'])"""),
    Rule(4, "http_exfiltration", "medium", "i", "urlretrieve() downloads file to local disk", r"urllib\.request\.urlretrieve\s*\(|urlretrieve\s*\("),
    Rule(5, "cloud_storage_write", "high", "i", "Dropbox API endpoint", r"(api\.dropboxapi\.com|content\.dropboxapi\.com|dropbox\.com/oauth2)"),
    Rule(6, "cloud_storage_write", "high", "i", "Dropbox SDK client initialization", r"\b(dropbox\.Dropbox|DropboxOAuth2FlowNoRedirect)\s*\("),
    Rule(7, "cloud_storage_write", "high", "i", "Box.com API endpoint", r"(api\.box\.com|upload\.box\.com|box\.com/api)"),
    Rule(8, "cloud_storage_write", "high", "i", "Google Drive API endpoint", r"(drive\.google\.com|www\.googleapis\.com/upload/drive|www\.googleapis\.com/drive)"),
    Rule(9, "cloud_storage_write", "high", "i", "MEGA cloud storage endpoint", r"(mega\.nz|mega\.co\.nz|g\.api\.mega\.co\.nz)"),
    Rule(10, "cloud_storage_write", "high", "i", "WeTransfer API/URL", r"(wetransfer\.com/api|we\.tl)"),
    Rule(11, "cloud_storage_write", "high", "i", "pCloud API endpoint", r"(api\.pcloud\.com|pcloud\.com/oauth2)"),
    Rule(12, "cloud_storage_write", "high", "i", "Firebase endpoint", r"(firebaseio\.com|firebasestorage\.googleapis\.com)"),
    Rule(13, "cloud_storage_write", "high", "i", "Supabase endpoint", r"\b\w+\.supabase\.co\b"),
    Rule(14, "cloud_storage_write", "high", "i", "Cloudinary upload endpoint", r"(api\.cloudinary\.com|cloudinary\.uploader)"),
    Rule(15, "cloud_storage_write", "high", "i", "Backblaze B2 storage endpoint", r"(backblazeb2\.com|b2_authorize_account|b2_upload_file)"),
    Rule(16, "cloud_storage_write", "high", "i", "iCloud API endpoint", r"(icloud\.com/api|setup\.icloud\.com)"),
    Rule(17, "cloud_storage_write", "high", "i", "Cloud storage upload SDK call", r"\b(upload_blob|upload_file|upload_fileobj|upload_from_string|upload_data|put_object|put_block_blob|put_item|put_record)\s*\("),
    Rule(18, "api_exfiltration", "high", "i", "Paste service API — data exfiltration risk", r"(pastebin\.com/api|api\.paste\.ee|dpaste\.com/api|ix\.io|sprunge\.us|hastebin\.com)"),
    Rule(19, "api_exfiltration", "high", "i", "GitHub Gists API — data exfiltration risk", r"api\.github\.com/gists"),
    Rule(20, "api_exfiltration", "high", "i", "GitLab Snippets API", r"(gitlab\.com/api.*snippets|snippets\.gitlab\.com)"),
    Rule(21, "api_exfiltration", "high", "i", "Airtable API endpoint", r"api\.airtable\.com"),
    Rule(22, "api_exfiltration", "high", "i", "Notion API endpoint", r"api\.notion\.(com|so)"),
    Rule(23, "webhook_exfiltration", "critical", "i", "Slack incoming webhook URL", r"https://hooks\.slack\.com/services/"),
    Rule(24, "webhook_exfiltration", "critical", "i", "Discord webhook URL", r"https://discord(app)?\.com/(api/)?webhooks/"),
    Rule(25, "webhook_exfiltration", "critical", "i", "Telegram bot API", r"https://api\.telegram\.org/bot"),
    Rule(26, "webhook_exfiltration", "high", "i", "AWS API Gateway endpoint", r"https://[^\s]*\.execute-api\.[^\s]*\.amazonaws\.com"),
    Rule(27, "webhook_exfiltration", "high", "i", "Serverless platform endpoint", r"https://[^\s]+(\.workers\.dev|\.vercel\.app|\.netlify\.app|\.pages\.dev|\.azurewebsites\.net)"),
    Rule(28, "api_exfiltration", "high", "i", "Microsoft Graph API call", r"https://graph\.microsoft\.com/v\d+\.\d+/(me|users|groups|drives|sites)"),
    Rule(29, "api_exfiltration", "high", "i", "Azure Management API call", r"https://management\.azure\.com/subscriptions"),
    Rule(30, "cross_workspace_operation", "high", "i", "Fabric REST API call from within notebook", r"https://api\.fabric\.microsoft\.com/v1/"),
    Rule(31, "api_exfiltration", "critical", "i", "Power BI streaming/push dataset API", r"https://api\.powerbi\.com/v1\.0/myorg/datasets/[^/]+/rows"),
    Rule(32, "api_exfiltration", "critical", "i", "Microsoft Graph SDK client", r"(GraphServiceClient|MSGraph|O365\.Account)\s*\("),
    Rule(33, "credential_access", "high", "i", "Fabric credential access", r"(mssparkutils|notebookutils)\.credentials\.(getSecret|getToken|getConnectionString|getFullConnectionString)"),
    Rule(34, "credential_access", "high", "i", "Token/secret library access", r"(TokenLibrary|dbutils\.secrets)\.(get|getSecret|getToken)"),
    Rule(35, "credential_access", "critical", "i", "Hardcoded Storage Account Key", r"AccountKey\s*=\s*[A-Za-z0-9+/=]{40,}"),
    Rule(36, "credential_access", "critical", "i", "SAS token with signature", r"(\?|&)sig=[A-Za-z0-9%+/=]{20,}"),
    Rule(37, "credential_access", "critical", "i", "SAS-tokened blob URL assignment", r"""["\']https?://[^"\s]+\.blob\.core\.windows\.net[^"\s]*sig=[^"\s]+["\']"""),
    Rule(38, "credential_access", "high", "i", "Hardcoded SQL password", r'(Password|pwd)\s*=\s*[^;\s"]{4,}'),
    Rule(39, "credential_access", "critical", "i", "Hardcoded client/app secret", r"""(client[_-]?secret|app[_-]?secret)\s*[=:]\s*["\']?[A-Za-z0-9~._-]{16,}"""),
    Rule(40, "credential_access", "critical", "i", "Hardcoded Bearer JWT token", r"""["\']Bearer\s+eyJ[A-Za-z0-9_-]{20,}"""),
    Rule(41, "credential_access", "critical", "i", "Hardcoded Event Hub / Service Bus key", r"SharedAccessKey\s*=\s*[A-Za-z0-9+/=]{30,}"),
    Rule(42, "credential_access", "critical", "i", "Hardcoded OpenAI API key", r"""(openai[_-]?api[_-]?key|OPENAI_API_KEY)\s*[=:]\s*["\']?sk-[A-Za-z0-9]{20,}"""),
    Rule(43, "credential_access", "critical", "i", "Hardcoded Azure OpenAI key", r"""(azure[_-]?openai[_-]?key|AZURE_OPENAI_KEY)\s*[=:]\s*["\']?[A-Fa-f0-9]{32}"""),
    Rule(44, "credential_access", "critical", "i", "Hardcoded Cosmos DB / Storage key", r"""(AccountKey|cosmosdb[_-]?key)\s*[=:]\s*["\']?[A-Za-z0-9+/=]{40,}"""),
    Rule(45, "credential_access", "high", "i", "Hardcoded API key", r"""(api[_-]?key|apikey|subscription[_-]?key|Ocp-Apim-Subscription-Key)\s*[=:]\s*["\']?[A-Za-z0-9]{16,}"""),
    Rule(46, "credential_access", "high", "i", "Hardcoded connection string", r"""(connection[_-]?string|conn[_-]?str)\s*[=:]\s*["\'][^"]{20,}["\']"""),
    Rule(47, "credential_access", "medium", "i", "Generic secret assignment", r"""(secret|password|passwd|token|credential)\s*[=:]\s*["\'][^"\s]{8,}["\']"""),
    Rule(48, "credential_access", "high", "i", "Spark config with storage account key", r"spark\.conf\.set\s*\([^)]*account\.key[^)]*\)"),
    Rule(49, "credential_access", "high", "i", "Spark config with external credentials", r"""spark\.conf\.set\s*\(\s*["\'].*(account\.key|access\.key|secret|password|token)"""),
    Rule(50, "credential_access", "critical", "i", "JDBC URL with embedded password", r'jdbc:[a-z]+://[^\s]*password=[^;\s"]{4,}'),
    Rule(51, "api_key_leak", "critical", "", "AWS Access Key ID (AKIA…)", r"\bAKIA[0-9A-Z]{16}\b"),
    Rule(52, "api_key_leak", "high", "", "AWS temporary session key (ASIA…)", r"\bASIA[0-9A-Z]{16}\b"),
    Rule(53, "api_key_leak", "critical", "", "AWS Secret Access Key (40-char base64)", r"""(?i)aws(.{0,20})?(secret|access)?[_-]?key[^\n]{0,20}["\'][A-Za-z0-9/+=]{40}["\']"""),
    Rule(54, "api_key_leak", "critical", "", "Google API key (AIza…)", r"\bAIza[0-9A-Za-z_\-]{35}\b"),
    Rule(55, "api_key_leak", "critical", "", "Google OAuth access token (ya29.…)", r"\bya29\.[0-9A-Za-z_\-]{20,}"),
    Rule(56, "api_key_leak", "high", "", "Google OAuth client ID", r"\b[0-9]+-[0-9A-Za-z_]{32}\.apps\.googleusercontent\.com\b"),
    Rule(57, "api_key_leak", "critical", "", "GitHub personal access token (ghp_/gho_/ghu_/ghs_/ghr_)", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    Rule(58, "api_key_leak", "critical", "", "GitHub fine-grained PAT (github_pat_…)", r"\bgithub_pat_[A-Za-z0-9_]{82}\b"),
    Rule(59, "api_key_leak", "critical", "", "GitLab personal access token (glpat-…)", r"\bglpat-[A-Za-z0-9\-_]{20,}\b"),
    Rule(60, "api_key_leak", "critical", "", "Anthropic API key (sk-ant-…)", r"\bsk-ant-(?:api03|sid01|admin01)-[A-Za-z0-9_\-]{80,}\b"),
    Rule(61, "api_key_leak", "critical", "", "OpenAI API key (sk-…T3BlbkFJ…)", r"\bsk-(?:proj-)?[A-Za-z0-9]{20,}T3BlbkFJ[A-Za-z0-9]{20,}\b"),
    Rule(62, "api_key_leak", "critical", "", "Hugging Face token (hf_…)", r"\bhf_[A-Za-z0-9]{30,}\b"),
    Rule(63, "api_key_leak", "critical", "", "Stripe secret key (sk_live_ / sk_test_)", r"\bsk_(?:live|test)_[0-9a-zA-Z]{24,}\b"),
    Rule(64, "api_key_leak", "critical", "", "Stripe restricted key (rk_live_ / rk_test_)", r"\brk_(?:live|test)_[0-9a-zA-Z]{24,}\b"),
    Rule(65, "api_key_leak", "medium", "", "Stripe publishable key (pk_live_ / pk_test_)", r"\bpk_(?:live|test)_[0-9a-zA-Z]{24,}\b"),
    Rule(66, "api_key_leak", "critical", "", "SendGrid API key (SG.…)", r"\bSG\.[A-Za-z0-9_\-]{20,}\.[A-Za-z0-9_\-]{30,}\b"),
    Rule(67, "api_key_leak", "high", "", "Mailgun API key (key-…)", r"\bkey-[a-f0-9]{32}\b"),
    Rule(68, "api_key_leak", "critical", "", "Slack token (xoxb-/xoxp-/xoxa-/xoxr-/xoxs-)", r"\bxox[abprs]-[A-Za-z0-9-]{10,}\b"),
    Rule(69, "api_key_leak", "critical", "", "Twilio API SID (SK…)", r"\bSK[a-f0-9]{32}\b"),
    Rule(70, "api_key_leak", "high", "", "Twilio Account SID (AC…)", r"\bAC[a-f0-9]{32}\b"),
    Rule(71, "api_key_leak", "critical", "", "Square access/app token (sq0atp/csp/idp-…)", r"\bsq0(?:atp|csp|idp)-[A-Za-z0-9_\-]{22,}\b"),
    Rule(72, "api_key_leak", "critical", "", "npm publish token (npm_…)", r"\bnpm_[A-Za-z0-9]{36}\b"),
    Rule(73, "api_key_leak", "critical", "", "PyPI upload token (pypi-…)", r"\bpypi-AgEIcHlwaS5vcmcC[A-Za-z0-9_\-]{50,}\b"),
    Rule(74, "api_key_leak", "critical", "", "DigitalOcean personal access token (dop_v1_…)", r"\bdop_v1_[a-f0-9]{64}\b"),
    Rule(75, "api_key_leak", "critical", "", "Shopify access token (shpat_…)", r"\bshpat_[a-f0-9]{32}\b"),
    Rule(76, "api_key_leak", "critical", "", "Shopify shared secret (shpss_…)", r"\bshpss_[a-f0-9]{32}\b"),
    Rule(77, "api_key_leak", "critical", "", "Discord bot token", r"\b[MN][A-Za-z\d]{23,28}\.[\w-]{6,7}\.[\w-]{27,}\b"),
    Rule(78, "api_key_leak", "high", "", "Bare JWT token (eyJ…header.payload.signature)", r"\beyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]{10,}"),
    Rule(79, "api_key_leak", "medium", "m", "High-entropy literal assigned to credential-shaped name", r"""(?i)\b(secret|client[_-]?id|token|api[_-]?key)\b[^\n]{0,12}=\s*["\'][A-Za-z0-9_\-]{32,128}["\']\s*(?:#.*high[_\- ]entropy|$|\n)"""),
    Rule(80, "in_notebook_package_install", "high", "im", "In-notebook package installation", r"^!pip\s+install\b|^%pip\s+install\b|^%conda\s+install\b"),
    Rule(81, "in_notebook_package_install", "critical", "i", "pip install from non-PyPI index", r"pip\s+install\s+.*--(index-url|extra-index-url)\s+http"),
    Rule(82, "shell_execution", "critical", "im", "Shell command for network file transfer", r"^!(curl|wget|nc|ncat|netcat|scp|rsync|ssh|sftp|ftp)\b"),
    Rule(83, "shell_execution", "high", "i", "Shell command execution", r"(os\.system|os\.popen|subprocess\.(run|Popen|call|check_output))\s*\("),
    Rule(84, "spark_external_write", "high", "i", "Spark write with external connector format", r"""\.format\s*\(\s*["\'](?:com\.mongodb|org\.apache\.spark\.sql\.cassandra|kafka|es\.spark)"""),
    Rule(85, "spark_streaming_exfiltration", "critical", "i", "Spark streaming to external broker", r"""writeStream.*\.format\s*\(\s*["\'](?:kafka|eventhubs|socket|mqtt|kinesis)["\']\s*\)"""),
    Rule(86, "spark_streaming_exfiltration", "high", "i", "Spark streaming foreachBatch — custom sink", r"writeStream.*foreachBatch"),
    Rule(87, "filesystem_exfiltration", "critical", "i", "File copy to external cloud storage", r"(dbutils\.fs\.cp|mssparkutils\.fs\.cp|shutil\.copy).*(?:s3|wasb|gs|abfss|adl|ftp)"),
    Rule(88, "spark_external_write", "high", "i", "Mounting external storage", r"(dbutils\.fs\.mount|mssparkutils\.fs\.mount)"),
    Rule(89, "filesystem_exfiltration", "high", "i", "mssparkutils/notebookutils file write/move", r"(mssparkutils|notebookutils)\.fs\.(put|append|mv)\s*\("),
    Rule(90, "external_database_write", "high", "i", "JDBC connection string to external database", r"""jdbc:(mysql|postgresql|sqlserver|oracle|db2|redshift|snowflake|bigquery)://[^\s\'"]+"""),
    Rule(91, "external_database_write", "high", "i", "Azure SQL connection string", r"Server\s*=\s*[^;]+\.database\.windows\.net"),
    Rule(92, "email_exfiltration", "high", "i", "Email sending capability", r"(smtplib\.SMTP|MIMEMultipart|MIMEText|send_message|sendmail)\s*[(\.]"),
    Rule(93, "email_exfiltration", "high", "i", "Transactional email API endpoint", r"(api\.sendgrid\.com|api\.mailgun\.net|mandrillapp\.com/api|api\.sparkpost\.com)"),
    Rule(94, "dns_exfiltration", "high", "i", "DNS resolution — potential DNS exfiltration", r"(dns\.resolver|dnspython|socket\.getaddrinfo)"),
    Rule(95, "dynamic_code_execution", "critical", "i", "Execution of decoded/deobfuscated code", r"(exec|eval)\s*\(\s*(base64|codecs|bytes\.fromhex|bytearray)"),
    Rule(96, "dynamic_code_execution", "critical", "i", "Dynamic access to builtins — obfuscation", r"getattr\s*\(\s*__builtins__"),
    Rule(97, "filesystem_exfiltration", "medium", "i", "Polars DataFrame write to file/database", r"\.write_(?:delta|parquet|csv|json|ndjson|ipc|arrow|avro|excel|database)\s*\("),
    Rule(98, "filesystem_exfiltration", "medium", "i", "Pandas DataFrame export to file/database", r"\.to_(?:csv|json|parquet|sql|excel|html|hdf|pickle|orc|feather|stata|gbq|xml)\s*\("),
    Rule(99, "external_database_write", "medium", "i", "SQL DML via .execute()", r"""\.execute\s*\(\s*[f"\']*(INSERT\s+INTO|UPDATE\s+|DELETE\s+FROM|MERGE\s+INTO)"""),
    Rule(100, "spark_external_write", "medium", "i", "spark.sql() with data-modifying statement", r"""spark\.sql\s*\(\s*f?["\']*(INSERT\s+INTO|UPDATE\s+|DELETE\s+FROM|MERGE\s+INTO)"""),
    Rule(101, "needs_update", "medium", "i", "fastcp() bulk copy detected - flag for migration / review", r"\b(?:mssparkutils|notebookutils)\.fs\.fastcp\s*\("),
    Rule(102, "needs_update", "medium", "i", "fastcp() bulk copy detected (bare call) - flag for migration / review", r"(?<!\.)\bfastcp\s*\("),
    Rule(103, "needs_update", "medium", "i", "fastcp imported - flag for migration / review", r"from\s+(?:mssparkutils|notebookutils)\.fs\s+import\s+[^\n#]*\bfastcp\b"),
)
